"""Walks over edges: reach, simple-path trees, shortest paths and closures.

Each round is a join of the frontier with the edges. Plans of many rounds are cut by a written checkpoint, so that neither
lineage nor the optimizer's work grows with depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.storage import checkpointed


def reach(edges: DataFrame, seeds: DataFrame, depth: int, undirected: bool = True) -> DataFrame:
    """node, distance of what is within `depth` steps of the seeds (node)."""
    steps = edges.select("source", "target")
    if undirected:
        steps = steps.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    steps = steps.distinct()
    seen = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = front.select(F.col("node").alias("source")).join(steps, "source").select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        front = checkpointed(front)
        seen = seen.unionByName(front)
    return seen


def focused(nodes: DataFrame, edges: DataFrame, focus: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """The neighbourhood of nodes whose label is the focus or whose id holds it; without any, the whole graph."""
    seeds = nodes.where((F.col("label") == focus) | F.col("id").contains(focus)).select(F.col("id").alias("node"))
    if seeds.isEmpty():
        return nodes, edges
    near = checkpointed(reach(edges, seeds, depth).select(F.col("node").alias("id")))
    keep = edges.join(near.select(F.col("id").alias("source")), "source", "left_semi").join(near.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes.join(near, "id", "left_semi"), keep


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """Impact trees: seed, node, level, path for each simple path of up to `depth` edges. Parallel edges are separate."""
    a, b = ("source", "target") if forward else ("target", "source")
    steps = edges.select(F.col(a).alias("at"), F.col(b).alias("next"), "kind")
    front = seeds.select(F.col("node").alias("seed"), F.col("node"), F.array("node").alias("path"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("kind"))
    out = None
    for d in range(1, depth + 1):
        grown = front.select("seed", F.col("node").alias("at"), "path").join(steps, "at").where(~F.array_contains("path", F.col("next")))
        front = grown.select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.lit(d).alias("level"), "kind")
        out = front if out is None else out.unionByName(front)
    return out


def impact_counts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """seed, direct (edges at level 1), total (distinct nodes), files (distinct paths), depth."""
    named = paths.join(nodes.select(F.col("id").alias("node"), F.col("path").alias("file")), "node", "left")
    return named.groupBy("seed").agg(F.count_if(F.col("level") == 1).alias("direct"), F.count_distinct("node").alias("total"), F.count_distinct("file").alias("files"), F.max("level").alias("depth"))


def shortest(edges: DataFrame, pairs: DataFrame, most: int = 8, direction: str = "forward") -> DataFrame:
    """start, goal, length and hops of a shortest path for each pair; of equals the one whose nodes sort first."""
    steps = edges.select("source", "target")
    flipped = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    steps = {"forward": steps, "reverse": flipped, "any": steps.unionByName(flipped)}[direction].distinct()
    front = pairs.select(F.col("start").alias("root"), F.col("start").alias("node"), F.array("start").alias("hops")).distinct()
    seen = front
    goals = pairs.select(F.col("start").alias("root"), F.col("goal")).distinct()
    for _ in range(most):
        grown = front.select("root", F.col("node").alias("source"), "hops").join(steps, "source").select("root", F.col("target").alias("node"), F.concat("hops", F.array("target")).alias("hops"))
        grown = grown.groupBy("root", "node").agg(F.min("hops").alias("hops")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = checkpointed(grown)
        seen = checkpointed(seen.unionByName(front))
        missing = goals.join(seen.select("root", F.col("node").alias("goal")), ["root", "goal"], "left_anti")
        # Only roots that still lack a goal go on.
        front = front.join(missing.select("root").distinct(), "root", "left_semi")
        if front.isEmpty():
            break
    found = seen.select(F.col("root").alias("start"), F.col("node").alias("goal"), "hops")
    return pairs.select("start", "goal").distinct().join(found, ["start", "goal"], "left").select("start", "goal", (F.size("hops") - 1).alias("length"), "hops")


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """All (source, target) pairs with a path between them, or those from roots (node). Only pairs found in the last round are
    joined: with all pairs, which doubles the length of paths in each round, or from roots with the edges."""
    steps = checkpointed(edges.select("source", "target").distinct())
    now = new = steps if roots is None else checkpointed(steps.join(roots.select(F.col("node").alias("source")).distinct(), "source", "left_semi"))
    while not new.isEmpty():
        onward = (now if roots is None else steps).select(F.col("source").alias("target"), F.col("target").alias("next"))
        more = new.join(onward, "target").select("source", F.col("next").alias("target")).distinct()
        new = checkpointed(more.join(now, ["source", "target"], "left_anti"))
        now = now.unionByName(new)
    return now


def owner_chains(symbols: DataFrame) -> DataFrame:
    """id and owners (names, outermost first) of each symbol (id, name, parent). A chain that comes back to a symbol ends there."""
    up = symbols.select(F.col("id").alias("at"), F.col("name").alias("owner"), F.col("parent").alias("above"))
    now = symbols.select("id", F.col("parent").alias("at"), F.array().cast("array<string>").alias("owners"), F.array("id").alias("seen"))
    done = None
    while True:
        over = F.col("at").isNull() | F.array_contains("seen", F.col("at"))
        ended = now.where(over).select("id", "owners")
        done = ended if done is None else done.unionByName(ended)
        step = now.where(~over).join(up, "at", "left")
        owners = F.when(F.col("owner").isNull(), F.col("owners")).otherwise(F.concat(F.array("owner"), "owners"))
        now = checkpointed(step.select("id", F.col("above").alias("at"), owners.alias("owners"), F.concat("seen", F.array("at")).alias("seen")))
        if now.isEmpty():
            return done
