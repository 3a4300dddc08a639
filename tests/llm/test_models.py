"""Toxicity, quality and language on held-out labels, and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language, nearest, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").cache() for t in ("documents", "labels", "embeddings")}


def test_toxicity_held_out(spark, tables):
    learn, rest = tables["labels"].where("doc_id % 5 <> 0"), tables["labels"].where("doc_id % 5 = 0 AND toxic IS NOT NULL")
    model = toxicity.fit_toxicity(tables["documents"], learn)
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.scored(tables["documents"].select("doc_id", "text"), model).join(rest, "doc_id").collect()
    clean = [r["__toxic"] for r in rows if not r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean)
    grades = lambda t: np.mean([r["__severity"] for r in rows if r["toxic"] == t])
    assert grades(1) > grades(0) + 0.5


def test_ordinal_fit_recovers_an_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 2)).astype(np.float32)
    z = 2 * x[:, 0] - x[:, 1] + r.logistic(size=3000)
    w, t = toxicity.fit_ordinal(x, np.digitize(z, [-1, 0.5, 2]), 3)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 1) < 0.3 and np.abs(t - [-1, 0.5, 2]).max() < 0.3


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 0), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.scored(docs, model)
    assert got.count() == docs.count() and got.where("__toxic").count() == 0 and toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(nothing, model).count() == 0 and not toxicity.fit_toxicity(nothing, labels).features.size


def test_quality_held_out(spark, tables):
    model = quality.fit_quality(tables["documents"], tables["labels"])
    got = quality.scored(tables["documents"], model).join(tables["labels"], "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([-np.log(max(1e-9, r["score"] if r["quality"] else 1 - r["score"])) for r in got]) < 0.2


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(nothing, model).count() == 0 and quality.fit_quality(nothing, labels).layers == ()


def test_quality_folds(spark):
    import zlib

    got = spark.range(200).select("id", quality.fold(F.col("id")).alias("f")).collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % 3 == r["f"] for r in got)


def test_features_do_not_depend_on_the_batch():
    texts = [b"a b c d", b"", b"x " * 500, "é ü".encode()]
    h = np.sort(np.array([3, 9], np.uint64))
    v = np.ones((2, quality.DIMS), np.float32)
    together, alone = quality.features(texts, h, v), np.concatenate([quality.features([t], h, v) for t in texts])
    assert np.allclose(together, alone)


def test_language_accuracy(spark, tables):
    d = tables["documents"].where("length(text) > 60")
    wrong = d.withColumn("lang", F.when(F.col("doc_id") % 6 == 0, F.lit("fr")).otherwise(F.col("lang")))
    got = language.identified(wrong, language.fit_trigrams(wrong), declared=F.col("lang"), host=F.col("source")).join(d.select("doc_id", F.col("lang").alias("real")), "doc_id").collect()
    assert np.mean([r["__language"] == r["real"] for r in got]) > 0.97 and all(r["__kept"] for r in got)


def test_evidence_decides_short_texts(spark, tables):
    model = language.fit_trigrams(tables["documents"])
    d = tables["documents"].select("text", "lang", F.concat("lang", F.lit(".example.org")).alias("host"), "lang AS suffix" if False else F.col("lang").alias("suffix"))
    short = spark.createDataFrame([("a", "es", "es.example.org", "es"), ("a", "de", "de.example.org", "de"), ("a", None, None, None)], "text string, lang string, host string, suffix string")
    got = language.identified(d.unionByName(short), model, declared=F.col("lang"), suffix=F.col("suffix"), host=F.col("host")).where("text = 'a'")
    assert {r["__language"] for r in got.where("lang IS NOT NULL").collect()} == {"es", "de"}


def test_language_edges(spark, docs, nothing):
    got = {}
    for model in (language.fit_trigrams(docs), language.Trigrams()):
        rows = language.identified(docs, model, declared=F.col("lang"), host=F.col("source"))
        assert rows.columns[: len(docs.columns)] == docs.columns and rows.count() == docs.count()
        got = {r["doc_id"]: r["__kept"] for r in rows.collect()}
        assert not any(got[i] for i in (3, 4, 5, 10)) and got[6] and got[None]
    assert language.identified(nothing, language.fit_trigrams(nothing)).count() == 0


def test_page_parts(spark):
    html = '<HTML lang="de-AT"><script>var x="<p>";</script><p>Guten <b>Tag</b></p>'
    df = spark.createDataFrame([(html, "http://Www.Ex.org/fr/1"), (None, None)], "html string, url string")
    text, declared, suffix, host = language.page_parts(F.col("html"), F.col("url"))
    rows = df.select(text.alias("t"), declared.alias("d"), suffix.alias("s"), host.alias("h")).collect()
    assert (" ".join(rows[0]["t"].split()), rows[0]["d"], rows[0]["s"], rows[0]["h"]) == ("Guten Tag", "de", "fr", "www.ex.org") and tuple(rows[1]) == (None,) * 4


def neighbours(x, ids, asked):
    out = {}
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q]
        out[q] = [ids[i] for i in order[: nearest.K]]
    return out


def test_recall(spark, tables):
    p = tables["embeddings"].toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    want = neighbours(x, ids, ids[ids % 20 == 0])
    got = nearest.nearest(tables["embeddings"], F.col("vec_id") % 20 == 0).toPandas()
    hit = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * sum(map(len, want.values())) and set(got["query_id"]) == set(want)


def test_tree_visits_widen(monkeypatch, spark):
    monkeypatch.setattr(nearest, "LEAF", 16)
    monkeypatch.setattr(nearest, "TILE_VECTORS", 10)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 3)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.1, (60, 6)) for c in r.normal(0, 1, (8, 6))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    want = neighbours(x, np.arange(len(x)), range(0, len(x), 20))
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.9 * 20 * len(want)
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert np.allclose(g["score"], x[g["vec_id"]] @ x[q]) and list(g["rank"]) == list(range(1, 21))


def test_vectors_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("inf"), 0.0]), (8, [0.5, 5.0]), (None, [1.0, 1.0]), (9, [])] + [(i, [1.0, 0.0]) for i in range(20, 60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = nearest.nearest(df, F.col("vec_id").isin(0, 2, 8)).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, *range(20, 39)] and [r["vec_id"] for r in got if r["query_id"] == 8] == [0, 1, *range(20, 38)]
    assert {r["query_id"] for r in got} == {0, 8} and nearest.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert [tuple(r)[:3] for r in nearest.nearest(df.where("vec_id IN (0, 8)"), F.col("vec_id") == 0).collect()] == [(0, 1, 8)]
