"""Vector retrieval, rank fusion and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.functions.vectors import cosine

FUSION_OFFSET, MOST_FUSED = 60, 100


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "key", vec: str = "vec", digits: int = 6) -> DataFrame:
    """The k rows of largest cosine, ties by key; rows without a valid cosine are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col(vec), q), digits)).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def best_chunk(scored: DataFrame, key: str = "key") -> DataFrame:
    """For each key its best chunk (score, start): the largest score, the smallest start of equals."""
    best = F.max(F.struct("score", (-F.col("start")).alias("m")))
    return scored.groupBy(key).agg(best.alias("b"), F.count(F.lit(1)).alias("chunks")).select(key, F.col("b.score").alias("score"), (-F.col("b.m")).alias("start"), "chunks")


def blended(body: Column, aux: Column, purpose: Column, purpose_aux: Column, aux_weight: float, body_weight: float) -> Column:
    """Relevance of up to four cosines; what is missing leaves its partner alone."""
    mix = lambda a, b, w: F.when(a.isNull(), b).when(b.isNull(), a).otherwise((1 - w) * a + w * b)
    return mix(mix(purpose, purpose_aux, aux_weight), mix(body, aux, aux_weight), body_weight)


def fused(branches: dict[str, DataFrame], key: str = "key", most: int = MOST_FUSED) -> DataFrame:
    """Reciprocal rank fusion of branches (key, place from 1): score and source, `hybrid` for keys of several branches."""
    both = None
    for name, rows in branches.items():
        part = rows.where(F.col("place") <= most).select(key, (1.0 / (FUSION_OFFSET + F.col("place"))).alias("part"), F.lit(name).alias("branch"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"), F.when(F.count(F.lit(1)) > 1, "hybrid").otherwise(F.min("branch")).alias("source"))


def windows(docs: DataFrame, words: Column, size: int, overlap: int, key: str = "key") -> DataFrame:
    """Chunks of `size` words that overlap: key, chunk, start, n, text. A last chunk that adds nothing is not made."""
    rows = docs.select(key, words.alias("words")).withColumn("n", F.size("words")).where("n > 0")
    last = F.greatest(F.col("n") - overlap - 1, F.lit(0))
    each = rows.select(key, "words", "n", F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start"))
    part = F.slice("words", F.col("start") + 1, F.lit(size))
    return each.select(key, (F.col("start") / (size - overlap)).cast("int").alias("chunk"), "start", F.size(part).alias("n"), F.array_join(part, " ").alias("text"))


def reusable(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs (key, text) with their hash, and whether a vector of that hash is known. Distinct inputs alone need inference."""
    hashed = inputs.withColumn("input_hash", F.sha2(F.col("text").cast("binary"), 256))
    return hashed.join(known.select("input_hash", F.lit(True).alias("known")).distinct(), "input_hash", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def expanded(seeds: DataFrame, edges: DataFrame, most_seeds: int = 32, most: int = 50) -> DataFrame:
    """Neighbours of the first seeds (key, place) that are no seeds themselves; each by its best seed."""
    first = F.broadcast(seeds.where(F.col("place") <= most_seeds).select("key", "place"))
    pairs = edges.select(F.col("source").alias("key"), F.col("target").alias("node")).unionByName(edges.select(F.col("target").alias("key"), F.col("source").alias("node")))
    near = pairs.join(first, "key").groupBy("node").agg(F.min("place").alias("place"))
    return near.join(first.select(F.col("key").alias("node")), "node", "left_anti").orderBy("place", "node").limit(most)


def supports(hits: DataFrame, relations: DataFrame, related: DataFrame, query: str, scanned: int = 50, kept: int = 3) -> DataFrame:
    """Up to `kept` related symbols for each hit (key): of its first `scanned` neighbours those that share most search terms with
    the query, then the most confident. relations: key, node, confidence, ordinal (their order); related: node, text. The
    hits are one answer's, so their number is the answer's limit."""
    once = relations.join(hits.select("key").distinct(), "key").groupBy("key", "node").agg(F.min(F.struct("ordinal", "confidence")).alias("r"))
    some = once.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("r.ordinal", "node"))).where(F.col("k") <= scanned)
    words = F.lit(query)
    overlap = F.size(F.array_intersect(terms(F.col("text")), F.array_distinct(terms(words))))
    rank = Window.partitionBy("key").orderBy(F.desc("overlap"), F.desc("confidence"), "node")
    found = some.select("key", "node", "r.confidence").join(related, "node").withColumn("overlap", overlap)
    return found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= kept).select("key", "node", "confidence", "overlap", "place")


def quality(hits: Column, best: Column, weak: float | None) -> Column:
    """One label for an answer, by its number of hits and the relevance of the first: empty, weak or candidate."""
    low = F.lit(False) if weak is None else best.isNull() | (best < weak)
    return F.when(hits == 0, "empty").when(low, "weak").otherwise("candidate")


#: The grade of an answer; lower ones count for the gain alone.
ANSWER = 3


def metrics(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, hit1, hit5, mrr, ndcg5 of ranked hits (query_id, item, place) under graded labels (query_id, item, grade)."""
    once = hits.groupBy("query_id", "item").agg(F.min("place").alias("place"))
    again = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "item")))
    graded = again.join(labels.where("grade > 0"), ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1.0)
    ideal = labels.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item"))).where("i <= 5")
    ideal = ideal.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("ideal"))
    good = F.when(F.col("grade") == ANSWER, F.col("place"))
    got = graded.groupBy("query_id").agg(F.min(good).alias("first"), F.sum(F.when(F.col("place") <= 5, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("dcg"))
    out = got.join(ideal, "query_id", "left")
    flag = lambda n: F.coalesce((F.col("first") <= n).cast("int"), F.lit(0))
    return out.select("query_id", flag(1).alias("hit1"), flag(5).alias("hit5"), F.coalesce(F.round(1.0 / F.col("first"), 6), F.lit(0.0)).alias("mrr"), F.coalesce(F.round(F.col("dcg") / F.col("ideal"), 6), F.lit(0.0)).alias("ndcg5"))


def latencies(records: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median and nearest-rank p95 of each group, from an exact percentile aggregation."""
    return records.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.expr(f"percentile({value}, 0.5D)"), 6).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def overlap_suppressed(hits: DataFrame, near: int = 5, share: float = 0.8) -> DataFrame:
    """Hits (query_id, item, file, kind, start, end, place) without the types of which a function or method within `near` places,
    before or after, lies to 80 % inside them."""
    outer = F.col("a.kind").isin("impl", "class", "struct")
    a, b = hits.alias("a"), hits.where(F.col("kind").isin("function", "method") & (F.col("end") > F.col("start"))).alias("b")
    common = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    near_by = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.file") == F.col("b.file")) & (F.abs(F.col("a.place") - F.col("b.place")) <= near)
    return a.join(b, outer & near_by & (common >= share * (F.col("b.end") - F.col("b.start"))), "left_anti")


def edge_accuracy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of required and forbidden edges (source, target, polarity) that were found, precision and recall."""
    hit = labels.join(edges.select("source", "target").distinct().withColumn("found", F.lit(1)), ["source", "target"], "left")
    n = hit.agg(F.count_if(F.col("polarity") == "must_have").alias("required"), F.count_if((F.col("polarity") == "must_have") & F.col("found").isNotNull()).alias("hits"), F.count_if((F.col("polarity") == "must_not_have") & F.col("found").isNotNull()).alias("forbidden"))
    return n.select("required", "hits", "forbidden", F.round(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("forbidden")), 6).alias("precision"), F.round(F.try_divide(F.col("hits").cast("double"), F.col("required")), 6).alias("recall"))
