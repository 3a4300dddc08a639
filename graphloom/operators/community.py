"""Communities by modularity (Louvain) on file links, their order and labels.

The method's result depends on the order in which nodes move, so one task runs it. What reaches that task is the aggregated
link table of files, one row for each pair of linked files, never symbols or references; `most_links` refuses more than
one task should hold."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESOLUTION, PASSES, LEVELS, LEAST_GAIN = 1.5, 20, 10, 1e-9
MOST_LINKS = 20_000_000


def louvain(links: list[tuple[str, str, float]], resolution: float = RESOLUTION) -> dict[str, int]:
    """Community of each node. Nodes are visited in sorted order; of equal gains the lowest community is taken."""
    names = sorted({n for a, b, _ in links for n in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in links:
        near[at[a]][at[b]] += w
        near[at[b]][at[a]] += w
    member = list(range(len(names)))
    for _ in range(LEVELS):
        placed, moved = _one_level(near, resolution)
        # Communities are numbered as they first appear, which is the order in which the next level visits them.
        ids = {c: k for k, c in enumerate(dict.fromkeys(placed))}
        if not moved or len(ids) == len(near):
            break
        member = [ids[placed[m]] for m in member]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in ids]
        for i, some in enumerate(near):
            for j, w in some.items():
                merged[ids[placed[i]]][ids[placed[j]]] += w
        near = merged
    return {n: member[i] for n, i in at.items()}


def _one_level(near: list[dict[int, float]], resolution: float) -> tuple[list[int], bool]:
    # A node's weight on itself, from merging, holds both directions already.
    degree = [sum(some.values()) for some in near]
    total = sum(degree) or 1.0
    own, weight, moved = list(range(len(near))), degree[:], False
    for _ in range(PASSES):
        changed = False
        for i, some in enumerate(near):
            around: dict[int, float] = defaultdict(float)
            for j, w in some.items():
                if j != i:
                    around[own[j]] += w
            home = own[i]
            weight[home] -= degree[i]
            best, gain = home, around.get(home, 0.0) - resolution * weight[home] * degree[i] / total
            for c in sorted(around):
                g = around[c] - resolution * weight[c] * degree[i] / total
                if g > gain + LEAST_GAIN:
                    best, gain = c, g
            weight[best] += degree[i]
            if best != home:
                own[i], changed, moved = best, True, True
        if not changed:
            break
    return own, moved


def communities(links: DataFrame, resolution: float = RESOLUTION, most_links: int = MOST_LINKS) -> DataFrame:
    """id, community, size: communities of two files or more, numbered by size, then by their first file. links: low, high, weight."""
    if links.count() > most_links:
        raise ValueError(f"more than {most_links} file links: select a scope first")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = louvain(list(rows[["low", "high", "weight"]].itertuples(index=False, name=None)), resolution)
        groups: dict[int, list[str]] = defaultdict(list)
        for n in sorted(found):
            groups[found[n]].append(n)
        kept = sorted((g for g in groups.values() if len(g) >= 2), key=lambda g: (-len(g), g[0]))
        return pd.DataFrame([(n, k, len(g)) for k, g in enumerate(kept) for n in g], columns=["id", "community", "size"])

    return links.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "id string, community long, size long")


def modularity(links: DataFrame, member: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row: the modularity of a partition, from three aggregations."""
    both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high"), "weight"))
    a = member.select(F.col("id").alias("low"), F.col("community").alias("ca"))
    b = member.select(F.col("id").alias("high"), F.col("community").alias("cb"))
    rows = both.join(a, "low").join(b, "high")
    per = rows.groupBy("ca").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    total = F.broadcast(per.agg(F.sum("degree").alias("total")))
    return per.join(total, F.lit(True)).agg(F.sum(F.col("inside") / F.col("total") - resolution * F.pow(F.col("degree") / F.col("total"), F.lit(2))).alias("modularity"))


def labels(member: DataFrame, path: str = "id") -> DataFrame:
    """community, label: up to two top directories that hold a fifth of its files each, else its first file; equal labels are numbered."""
    from pyspark.sql import Window

    top = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))
    counts = member.groupBy("community", "size", top.alias("top")).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "top")
    ranked = counts.withColumn("k", F.row_number().over(order)).groupBy("community").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("k") <= 2) & F.col("top").isNotNull() & (5 * F.col("n") >= F.col("size")), F.struct("k", "top")))), lambda x: x["top"]), " + ").alias("dirs"),
        F.min("first").alias("first"),
    )
    named = ranked.select("community", F.when(F.col("dirs") != "", F.col("dirs")).otherwise(F.col("first")).alias("label"))
    again = F.row_number().over(Window.partitionBy("label").orderBy("community"))
    return named.withColumn("k", again).select("community", F.when(F.col("k") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("label"))
