"""Queries of language identification. A fitted model has no SQL; the tests measure it on texts of known language."""

from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.language import fit_trigrams, identified, page_parts


def op7_language_id(spark, sf_dir):
    """Documents: their lang column is the declaration and their source the host; they have no address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = identified(docs, fit_trigrams(docs), declared=F.col("lang"), host=F.col("source"), returned=["doc_id"])
    return got.select("doc_id", F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__kept").alias("kept"))


def language_of_pages(spark, sf_dir):
    """Pages: text without markup, the declared markup language, the address suffix and the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    text, declared, suffix, host = page_parts(F.col("html"), F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    got = identified(pages, fit_trigrams(docs), declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), returned=["page_id"])
    return got.select("page_id", F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__kept").alias("kept"))


QUERIES = {"op7_language_id": op7_language_id, "language_of_pages": language_of_pages}
ORACLE = {}
