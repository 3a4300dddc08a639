"""Query of the quality classifier. A fitted model has no SQL; the tests measure it on the held-out fold."""

from graphloom.llm.common import table
from graphloom.llm.quality import fit_quality, scored


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality": op6_quality}
ORACLE = {}
