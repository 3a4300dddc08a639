"""Connected components by alternating large-star and small-star steps; edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. One step, oriented the same way."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(low, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", roots: bool = True) -> DataFrame:
    """node, component (the smallest node that it reaches), for each node with an edge to another; without roots, nodes that name
    their component have no row."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    sums = [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")]
    before, written = None, False
    while True:
        last, now = now, materialize(_stars(_stars(now, large=True), large=False), "edges")
        if written:
            drop(last)
        written = True
        seen = tuple(now.agg(*sums).first())
        if seen == before or not seen[0]:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found if not roots else found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = seen
