"""Content index: postings and BM25 ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.operators.storage import checkpointed

K1, B = 1.2, 0.75


def postings(docs: DataFrame, content: Column, key: str = "key") -> DataFrame:
    """key, length (the document's number of terms), term, tf. Terms are counted inside their row, in order; nothing is shuffled."""
    words = docs.select(key, F.array_sort(terms(content)).alias("words")).where(F.size("words") > 0)
    n, word = F.size("words"), lambda i: F.col("words")[i]
    starts = words.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (word(i) != word(i - 1))))
    run = lambda at, k: F.struct(word(at).alias("term"), (F.coalesce(F.get("starts", k + 1), n) - at).cast("long").alias("tf"))
    return starts.select(key, n.alias("length"), F.explode(F.transform("starts", run)).alias("x")).select(key, "length", "x.term", "x.tf")


def bm25(docs: DataFrame, content: Column, query_terms: list[str], candidates: Column | None = None, key: str = "key", digits: int = 6) -> DataFrame:
    """key and score of the documents that hold a query term. `candidates` filters what is scored, never what is counted.

    Each document is read and tokenized once, to its length and the counts of the query's terms. What the corpus holds is summed
    on the way; narrow rows of documents with a query term are written once."""
    query_terms = sorted(set(query_terms))
    wanted = F.filter("__words", lambda w: w.isin(query_terms))
    kept = F.lit(True) if candidates is None else F.coalesce(candidates, F.lit(False))
    rows = docs.select(key, kept.alias("__kept"), terms(content).alias("__words")).select(key, "__kept", F.size("__words").alias("length"), wanted.alias("__hits"))
    times = lambda t: F.size(F.filter("__hits", lambda w: w == t))
    tf = [times(t).alias(f"tf_{i}") for i, t in enumerate(query_terms)]
    rows = rows.select(key, "__kept", "length", *tf)
    names = [f"tf_{i}" for i in range(len(query_terms))]
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), *[F.count_if(F.col(c) > 0).alias(c) for c in names])
    held = F.lit(False)
    for c in names:
        held |= F.col(c) > 0
    scored = checkpointed(counted.where(F.col("__kept") & held))
    n, total = seen.get["n"], seen.get["total"]
    norm = K1 * (1 - B + B * F.col("length") / max(total / max(n, 1), 1.0))
    score = F.lit(0.0)
    for c in names:
        df = seen.get[c]
        score += math.log(1 + max(n - df + 0.5, 0.0) / (df + 0.5)) * F.col(c) * (K1 + 1) / (F.col(c) + norm)
    return scored.select(key, F.round(score, digits).alias("score"))


def bm25_from_postings(posts: DataFrame, query_terms: list[str], key: str = "key", digits: int = 6) -> DataFrame:
    """The same scores from a stored index (key, length, term, tf)."""
    totals = posts.groupBy(key).agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    hits = posts.where(F.col("term").isin(query_terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(totals), F.lit(True))
    average = F.greatest(F.col("total") / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0))
    idf = F.log(1 + F.greatest(F.col("n") - F.col("df") + 0.5, F.lit(0.0)) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    return rows.groupBy(key).agg(F.round(F.sum(part), digits).alias("score"))


def gaps(spans: DataFrame, sizes: DataFrame, key: str = "file_id") -> DataFrame:
    """Uncovered stretches of each file: key, gap_start, gap_end. spans: key, start, end; sizes: key, size."""
    ends = sizes.select(key, F.col("size").alias("start"), F.col("size").alias("end"))
    order = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.select(key, "start", "end").unionByName(ends).withColumn("gap_start", F.coalesce(F.max("end").over(order), F.lit(0)))
    return reached.where(F.col("gap_start") < F.col("start")).select(key, "gap_start", F.col("start").alias("gap_end"))
