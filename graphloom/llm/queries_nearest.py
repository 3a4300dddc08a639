"""Query of the nearest-neighbour search. Being approximate it has no SQL; the tests measure its recall against brute force."""

from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.nearest import nearest


def op8_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op8_nearest": op8_nearest}
ORACLE = {}
