"""Small joins around the index and the graph: candidates for hybrid search, facts of hits, changed identities, communities of
symbols, what is to be indexed again, and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import search


def hybrid_candidates(symbols: DataFrame, query: str, kind: str | None = None, exported: bool | None = None, fuzzy: bool = True) -> DataFrame:
    """Lexical candidates of a hybrid search: names that hold the query; without any, those that are identifiers of the query; without
    any, near ones. `tier` tells which. One row of counts decides and is broadcast."""
    named = search.name_search(symbols, query, "substring", kind, exported).drop("inexact").withColumn("tier", F.lit(0))
    exact = F.lit(False)
    for word in search.identifiers(query):
        exact |= search.ascii_lower(F.col("name")) == search.ascii_folded(word)
    ok = F.lit(True)
    if kind is not None:
        ok &= F.col("kind") == kind
    if exported is not None:
        ok &= F.col("is_exported") == exported
    own = symbols.where(exact & ok).withColumn("tier", F.lit(1))
    tiers = named.unionByName(own)
    if fuzzy:
        tiers = tiers.unionByName(search.fuzzy_search(symbols, query).where(ok).drop("distance").withColumn("tier", F.lit(2)))
    least = F.broadcast(tiers.agg(F.min("tier").alias("least")))
    return tiers.join(least, F.col("tier") == F.col("least")).drop("least")


def with_facts(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits (key, path, name, start, end) with the declaration they show: the symbol of the same key, else the only one of the same name
    in the file that overlaps. symbols: key, path, name, start, end, symbol_id."""
    same = hits.join(symbols.select("key", F.col("symbol_id").alias("own")), "key", "left")
    s = symbols.select("path", "name", F.col("start").alias("low"), F.col("end").alias("high"), "symbol_id")
    open_ = same.where("own IS NULL").select("key", "path", "name", "start", "end").join(s, ["path", "name"]).where("low < end AND high > start")
    only = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("found")).where("n = 1")
    return same.join(only.select("key", "found"), "key", "left").select(*hits.columns, F.coalesce("own", "found").alias("symbol_id"))


def identity_changes(before: DataFrame, after: DataFrame, identity: list[str], content: str = "hash") -> DataFrame:
    """identity and change of what differs between two revisions: modified, added or deleted. Several symbols of one identity are one."""
    sums = lambda df, name: df.groupBy(*identity).agg(F.array_sort(F.collect_list(content)).alias(name))
    both = sums(before, "a").join(sums(after, "b"), identity, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*identity, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified").alias("change"))


def inherited_communities(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """nodes with the community of their file, null without one. member: id (of a file node), community."""
    of = member.select(F.expr("substring(id, 6)").alias("path"), "community")
    return nodes.join(of, "path", "left").select(*nodes.columns, "community")


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by source, target and kind, for a sink that others compare."""
    return nodes.orderBy("id"), edges.orderBy("source", "target", "kind")


def to_index(files: DataFrame, marks: DataFrame, version: str) -> DataFrame:
    """Files (file_id, content_hash) whose index is missing, of other content or of another version. marks: file_id, marker."""
    wanted = files.withColumn("marker", F.concat(F.lit(f"{version}:"), "content_hash"))
    return wanted.join(marks.select("file_id", "marker"), ["file_id", "marker"], "left_anti")


def generation(meta: DataFrame, status: DataFrame) -> DataFrame:
    """One row: the store's next generation, which grows if any file was added, changed or removed, and whether answers of exact tools
    are to be asked again. meta: key, value; status: path, status."""
    now = meta.where("key = 'generation'").agg(F.coalesce(F.max(F.col("value").cast("long")), F.lit(0)).alias("now"))
    moved = status.agg(F.count_if(F.col("status").isin("added", "changed", "removed")).alias("moved"))
    return now.join(moved, F.lit(True)).select((F.col("now") + (F.col("moved") > 0).cast("long")).alias("generation"), (F.col("moved") > 0).alias("invalid"))


def usable(version: Column, readable: tuple[int, ...], current: int) -> Column:
    """What becomes of a store of a schema version: keep, migrate or rebuild."""
    return F.when(version == current, "keep").when(version.isin(*readable), "migrate").otherwise("rebuild")
