"""Signatures, comments and stand-in embeddings."""

import duckdb
from pyspark.sql import functions as F

from compare import rows_of
from graphloom import queries
from graphloom.functions.vectors import normalized, rounded
from graphloom.operators import explain

SOURCE = """/// Adds two.
/// Twice.
#[inline]

pub fn add(
    a: u32,
) -> u32 {
    a
}
let x = 1;
// not for the next
let y = 2;
fn bare() {}
"""


def test_signature_and_comment(spark):
    df = spark.createDataFrame([(SOURCE, 5), (SOURCE, 13), (SOURCE, 12), (SOURCE, 1)], "c string, n int")
    got = df.select(explain.signature(F.col("c"), F.col("n")).alias("s"), explain.doc_comment(F.col("c"), F.col("n")).alias("d")).collect()
    assert got[0]["s"] == "pub fn add( a: u32, ) -> u32" and got[0]["d"] == "Adds two.\nTwice."
    assert got[1]["s"] == "fn bare()" and got[1]["d"] is None and got[2]["d"] == "not for the next" and got[3]["d"] is None


def test_hash_embedding(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "w array<string>").select(explain.hash_embedding(F.col("w"), 8).alias("v"))
    rows = df.select("v", normalized(F.col("v")).alias("n")).collect()
    assert sum(map(abs, rows[0]["v"])) in (1.0, 3.0) and rows[1]["n"] is None and len(rows[0]["v"]) == 8


def test_stale(spark):
    meta = spark.createDataFrame([("analyzer_revision", "3")], "key string, value string")
    assert explain.stale(meta, "4") and not explain.stale(meta, "3") and explain.stale(meta.where("false"), "3")


def test_includes(spark):
    df = spark.createDataFrame([('#include "a.h"\n  # include <b/c.h>\nint x;',)], "c string")
    assert df.select(explain.include_specifiers(F.col("c"))).first()[0] == ["a.h", "b/c.h"]


def test_normalize_vectors_as_its_sql(spark, tmp_path):
    """Signs of zeros, short, empty, zero and non-finite vectors."""
    inf, nan = float("inf"), float("nan")
    odd = [[-1e-9, 1.0] + [0.0] * 62, [0.0] * 64, [], None, [3.0, -4.0], [nan] + [1.0] * 63, [inf] + [1.0] * 63, [0.0625, -0.0] * 32, [1e-30] * 64, [1.0 + k for k in range(70)]]
    spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["normalize_vectors"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["normalize_vectors"](spark, str(tmp_path)).select("vec_id", "v").collect()]
    assert rows_of(["vec_id", "v"], got) == rows_of(["vec_id", "v"], want)
    assert [len(v) for _, v in sorted(got) if v is not None] == [len(v) for v in odd if v is not None]


def test_rounded(spark):
    x = [0.5e-6, -0.5e-6, 1.5e-6, -4e-7, 0.0, 1e300, -0.1234565]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(rounded(F.col("x"), 6)).collect()
    want = duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [x]).fetchall()
    assert [str(r[0]) for r in got] == [str(r[0]) for r in want]
