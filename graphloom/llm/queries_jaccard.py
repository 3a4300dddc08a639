"""Query of the n-gram Jaccard join. SQL that compares all documents which share a shingle is too slow on whole tables; the tests
compare all pairs of small ones."""

from graphloom.llm.common import table
from graphloom.llm.jaccard_join import near_copies


def op4_jaccard_join(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents")).drop("digest", "key", "component")


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE = {}
