"""Keeping tables current by content hashes (sync status, cascades, replacement of a file's rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def sync_status(old: DataFrame, new: DataFrame, analyzer: str = "1") -> DataFrame:
    """path and status (added, changed, unchanged, removed, out_of_scope) of each file of either snapshot.

    old: path, content_hash, analyzer; new: path, content_hash, in_scope. A file is parsed again when its content or the
    analyzer's revision changed. A file outside the selected scope is not a removed one."""
    a = old.select("path", F.col("content_hash").alias("old_hash"), F.col("analyzer").alias("old_analyzer"), F.lit(True).alias("was"))
    b = new.select("path", F.col("content_hash").alias("new_hash"), "in_scope", F.lit(True).alias("here"))
    same = (F.col("old_hash") == F.col("new_hash")) & (F.col("old_analyzer") == analyzer)
    status = (
        F.when(F.col("here").isNull(), "removed").when(~F.col("in_scope"), "out_of_scope").when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")


def sync_counts(status: DataFrame) -> DataFrame:
    """scanned: the files on disk and in scope."""
    names = ("added", "changed", "unchanged", "removed", "out_of_scope")
    return status.agg(F.count_if(F.col("status").isin(*names[:3])).alias("scanned"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def without_files(child: DataFrame, doomed: DataFrame, key: str = "file_id") -> DataFrame:
    """Cascade: the child rows of files that stay."""
    return child.join(doomed.select(key).distinct(), key, "left_anti")


def replaced(current: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "file_id") -> DataFrame:
    """A new version of a child table: rows of touched files go, their fresh rows come."""
    return without_files(current, touched, key).unionByName(fresh)


def upserted(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def index_coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many files, files with chunks, chunks, valid and stale chunks there are. chunks: file_id, source_hash, valid."""
    per = chunks.join(files.select("file_id", "content_hash"), "file_id", "left").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("valid") & (F.col("source_hash") == F.col("content_hash"))).alias("fresh"),
    )
    joined = files.join(per, "file_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.agg(F.count(F.lit(1)).alias("files"), F.count("chunks").alias("indexed"), total("chunks").alias("chunks"), total("fresh").alias("fresh"), total(F.col("chunks") - F.col("fresh")).alias("stale"))


def with_ids(rows: DataFrame, order: list[str], parent_ordinal: str | None = None, key: str = "path") -> DataFrame:
    """Deterministic ids for rows of all files: the position within a file and the file's first id. Files are numbered by
    counts per file, so only these small counts are ordered as a whole; rows stay where they are."""
    from pyspark.sql import Window

    local = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    counts = rows.groupBy(key).count()
    # The files' offsets: a running sum in blocks, so that no task holds all files.
    blocks = counts.withColumn("block", F.pmod(F.xxhash64(key), F.lit(256)))
    inside = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    totals = blocks.groupBy("block").agg(F.sum("count").alias("n"))
    base = totals.alias("a").join(totals.alias("b"), F.col("b.block") < F.col("a.block"), "left").groupBy("a.block").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base")).select(F.col("block"), "base")
    offsets = starts.join(F.broadcast(base), "block").select(key, (F.col("before") + F.col("base")).alias("offset"))
    out = local.join(offsets, key).withColumn("id", F.col("offset") + F.col("ordinal") + 1)
    if parent_ordinal:
        out = out.withColumn("parent_id", F.when(F.col(parent_ordinal).isNotNull(), F.col("offset") + F.col(parent_ordinal) + 1))
    return out.drop("offset")
