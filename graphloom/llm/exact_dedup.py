"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary over all digests names the frequent ones. Their winners are found by an exact aggregation,
broadcast (their number is bounded by the summary's size) and joined on the map side, so that no frequent digest is
ever shuffled row by row. All other digests meet in an ordinary shuffle.

Defined cases: a null text counts as empty, and empty texts are equal to each other; a null doc_id loses to any other;
of rows that repeat a doc_id and its text one stays (the one that comes last in the input); columns besides doc_id and
text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, free, materialize, short

#: Misra-Gries counters. Every digest of more than about 4 / COUNTERS of all rows is found.
COUNTERS = 8192
#: At most so many winners are broadcast (each about 100 bytes).
MOST_WINNERS = 2000


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_sha256 and seat, a number for the row, as a table: texts are read and hashed once."""
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normal.cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("seat")), "digests")


def frequent(keys: DataFrame, column: str, counters: int = COUNTERS, most: int = MOST_WINNERS) -> DataFrame:
    """Candidates for frequent values, from a mergeable Misra-Gries summary of all rows; at most `most` rows."""
    top = keys.agg(F.expr(f"approx_top_k({column}, {most}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("x")).where(F.col("x.count") > 1).select(F.col("x.item").alias(column))


def decide(rows: DataFrame, counters: int = COUNTERS, most: int = MOST_WINNERS) -> DataFrame:
    """For each row of digests(): the winner's doc_id, the group's size and whether the row stays."""
    heavy = frequent(rows, "text_sha256", counters, most)
    order = F.struct(F.col("doc_id"), F.col("seat"))
    winners = rows.join(F.broadcast(heavy), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.max(order).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    winners = materialize(winners, "winners")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").withColumns({"winner": F.max(order).over(group), "group_size": F.count(F.lit(1)).over(group)})
    both = hot.select(*cold.columns).unionByName(cold)
    return both.select("doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("seat") == F.col("winner.seat")).alias("kept"), "text_sha256", "seat")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return decide(digests(docs, doc_id, text)).drop("seat")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that lose. Rows that share both doc_id and text are merged to one before the join."""
    sha, mine, lost_sha, again = (free(c, docs) for c in ("sha", "lost_id", "lost_sha", "again"))
    named = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    fate = decide(digests(docs))
    lost = fate.where(~F.col("kept")).groupBy(F.col("doc_id").alias(mine), F.col("text_sha256").alias(lost_sha)).agg((F.max("keep_id").eqNullSafe(F.col("doc_id"))).alias(again))
    lost = short(materialize(lost, "lost"))
    joined = named.join(lost, F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(sha) == F.col(lost_sha)), "left")
    once = joined.where(F.col(lost_sha).isNull()).select(*docs.columns)
    twice = joined.where(F.col(again)).groupBy("doc_id", sha).agg(F.max(F.struct(*docs.columns)).alias(mine)).select(f"{mine}.*")
    return once.unionByName(twice)
