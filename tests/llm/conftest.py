import pytest

LONG = "word " * 60_000
#: doc_id, text, and columns whose names clash with what the operators add.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s", "k"), (2, "alpha BETA gamma delta epsilon zeta", "en", "s", "k"), (3, None, None, None, None), (4, "", "en", "s", "k"),
    (5, " \n\t ", "fr", "s", "k"), (6, LONG, "en", "s", "k"), (7, "Élan vital", "fr", "t", "k"), (8, "élan vital", "fr", "t", "k"), (None, "no id at all", "en", None, "k"),
    (9, "twice", "en", "s", "k"), (9, "twice", "en", "s", "k"), (9, "twice but not quite", "en", "s", "k"), (10, "!!! ???", "en", "s", "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "1L AS n", "'x' AS kept", "0L AS id", "'y' AS seat", "false AS asked", "2 AS label")


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
