import pytest
from pyspark.sql import functions as F

from graphloom.llm import language


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").cache()


def test_a_rare_language_has_a_model(spark, documents):
    es = documents.where("lang = 'es'")
    first = es.orderBy("doc_id").limit(3).select("doc_id")
    en = documents.where("lang = 'en'")
    rare = en.unionByName(en.withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(es.join(first, "doc_id", "left_semi").select(documents.columns))
    model = language.fit_trigrams(rare)
    assert model.languages == ["en", "es"]
    got = language.identified(es.join(first, "doc_id", "left_anti"), model, declared=F.lit(None).cast("string"))
    share = got.agg(F.avg((F.col("__language").eqNullSafe("es")).cast("double"))).first()[0]
    assert share > 0.9, share


@pytest.mark.parametrize("out", ["es", "fr"])
def test_a_language_without_model_is_rejected(spark, documents, out):
    model = language.fit_trigrams(documents.where(F.col("lang") != out))
    got = language.identified(documents, model, declared=F.col("lang"), host=F.col("source"))
    kept = {r["own"]: r["kept"] for r in got.groupBy((F.col("lang") == out).alias("own")).agg(F.avg(F.col("__kept").cast("double")).alias("kept")).collect()}
    assert kept[True] < 0.2 and kept[False] > 0.99, kept
