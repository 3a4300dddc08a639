"""Query of SentencePiece encoding: every document is encoded, and what its ids decode to is digested."""

from graphloom.llm.common import table
from graphloom.llm.sentence_pieces import decoded, encoded, model_path


def op3_sentencepiece(spark, sf_dir):
    model = model_path()
    return decoded(encoded(table(spark, sf_dir, "documents"), model), model)


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLE = {}
