"""Query of toxicity. A fitted model has no SQL; the tests measure it on held-out labels."""

from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.toxicity import fit_toxicity, scored


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", F.col("__severity").alias("severity"), F.round("__severity").cast("int").alias("grade"), F.col("__toxic").alias("toxic"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE = {}
