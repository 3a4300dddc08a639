"""Query of packing. SQL has no tokenizer, so the tests hold it against a plain version."""

from graphloom.llm.common import table
from graphloom.llm.packing import packed


def op9_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE = {}
