"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and their first 4 to 7 bytes, lower-cased and without punctuation; a feature's value is the log of one
plus its count. P(grade > k) = sigmoid(w x - t_k): one weight vector shared by all thresholds, which are kept in order.
A text's severity is its expected grade, the sum of these probabilities; it is toxic if the chance of a grade above 0 exceeds TOXIC_AT.

Labels only tell toxic from not. The grades of toxic training rows come from how many marks they hold, a mark being a
feature that toxic rows have far more often than others: thirds of the toxic rows by that count are grades 1, 2 and 3.
The regression is fitted on at most `most_rows` labelled rows, taken by the hash of their id; features and their counts
come from these rows.

Defined cases: a null or empty text has severity below any threshold's midpoint (no features); rows without a label are
scored alike; without toxic training rows all texts are clean; a null doc_id stays null; repeated rows are scored each;
other columns stay untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import free, materialize
from graphloom.llm.words import MARKS, ODD, mixed, raw_lower, text_chunks, word_arrays

PREFIXES = (4, 5, 6, 7)
MOST_ROWS, MOST_FEATURES = 20_000, 800
GRADES = 3
#: A text is toxic if the chance of a grade above 0 is over this; false alarms stay rare well below one half.
TOXIC_AT = 0.2
#: Least log likelihood ratio of a mark: words that toxic rows share by chance stay below it.
LEAST_GAIN = 8.0


@dataclass
class Ordinal:
    """Weights of features (sorted hashes) and the ordered thresholds."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 9.0))

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def feature_counts(texts: list[str | None], features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the positions in features (sorted) that it holds, and how often."""
    arrays, counts = word_arrays(raw_lower(texts), MARKS, PREFIXES)
    row, found = [], []
    doc = np.repeat(np.arange(len(texts)), counts)
    for k, h in enumerate(arrays):
        at = np.searchsorted(features, h)
        at[at == len(features)] = 0
        hit = features[at] == h if len(features) else np.zeros(len(h), bool)
        for before in arrays[:k]:  # a word that is shorter than a prefix is the same feature again
            hit &= before != h
        row.append(doc[hit])
        found.append(at[hit])
    pairs, n = np.unique(np.concatenate(row) * max(1, len(features)) + np.concatenate(found), return_counts=True)
    ends = np.searchsorted(pairs // max(1, len(features)), np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield pairs[a:b] % max(1, len(features)), n[a:b]


def _presence(batches):
    """feature, toxic, clean: how many rows of either label hold each feature."""
    for part in text_chunks(batches):
        arrays, counts = word_arrays(raw_lower(part.column("text").to_pylist()), MARKS, PREFIXES)
        toxic = np.array(part.column("toxic").to_pylist(), bool)
        doc = np.repeat(np.arange(len(counts)), counts)
        flat, of = np.concatenate(arrays), np.tile(doc, len(arrays))
        _, once = np.unique(mixed(flat + of.astype(np.uint64) * ODD), return_index=True)
        keys, at = np.unique(flat[once], return_inverse=True)
        is_toxic = toxic[of[once]]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, is_toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(at, ~is_toxic, len(keys)).astype(np.int64))], ["feature", "toxic", "clean"])


def chosen_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled ids, by the hash of the id, whose list is broadcast. Where documents
    repeat these ids, about `most` of their rows."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    some = materialize(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", label)
    n = rows.count()
    return rows if n <= most else rows.where(F.rand(11) < most / n)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Ordinal:
    rows = chosen_rows(docs, labels, "toxic", most_rows).select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))
    sizes = rows.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Ordinal()
    seen = rows.mapInArrow(_presence, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # How surprising a feature's rows would be if they were toxic as often as all rows are (a log likelihood ratio).
    rate, rows_held = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (rows_held * rate)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (rows_held * (1 - rate)))).otherwise(0.0)
    marks = seen.where((F.col("toxic") > 0) & (F.col("toxic") / n_toxic > 6 * F.col("clean") / n_clean)).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    marks = marks.orderBy(F.desc("gain"), "feature").limit(MOST_FEATURES).toPandas()
    features = np.sort(marks["feature"].to_numpy(np.int64).view(np.uint64))
    if not len(features):
        return Ordinal()

    def counted(batches):
        for part in text_chunks(batches):
            got = list(feature_counts(part.column("text").to_pylist(), features))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic"), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int64())), pa.array([n.tolist() for _, n in got], pa.list_(pa.int64()))], ["doc_id", "toxic", "at", "n"])

    table = rows.mapInArrow(counted, "doc_id long, toxic boolean, at array<long>, n array<long>").toPandas().sort_values("doc_id", kind="stable")
    # Rows without any feature are alike: one row of each label stands for all of them, with their number as its weight.
    table["held"] = table["at"].map(len) > 0
    some = table[table["held"]]
    bare = table[~table["held"]].groupby("toxic").size()
    x = np.zeros((len(some) + len(bare), len(features)), np.float32)
    for i, (at, n) in enumerate(zip(some["at"], some["n"], strict=True)):
        x[i, np.asarray(at, np.int64)] = np.log1p(np.asarray(n, np.float64))
    toxic = np.concatenate([some["toxic"].to_numpy(bool), bare.index.to_numpy(bool)])
    shares = np.concatenate([np.ones(len(some)), bare.to_numpy(float)])
    marks_held = np.expm1(x).sum(axis=1)
    cuts = np.quantile(np.repeat(marks_held[toxic], shares[toxic].astype(int)), [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (marks_held > cuts[0]).astype(int) + (marks_held > cuts[1]), 0)
    weights, thresholds = fit_ordinal(x, grades, GRADES, shares)
    return Ordinal(features, weights, thresholds)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, top: int, shares: np.ndarray | None = None, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the likelihood of the grades. Thresholds are a first one and positive steps, so they stay in order."""
    n, f = x.shape
    shares = np.full(n, 1 / n) if shares is None else shares / shares.sum()
    x = x.astype(np.float32)
    params = np.concatenate([np.zeros(f), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, first, gaps = params[:f], params[f], np.exp(params[f + 1 :])
        t = first + np.concatenate([[0.0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float)[:, None] - t[None, :], -40, 40)))
        # P(grade = k) is a difference of neighbours; its gradient follows from those of both.
        bounds = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slopes = bounds * (1 - bounds)
        mine = np.arange(n)
        likely = np.maximum(bounds[mine, grades] - bounds[mine, grades + 1], 1e-9)
        up, down = slopes[mine, grades] / likely, slopes[mine, grades + 1] / likely
        score = -(up - down) * shares
        at_t = np.zeros((n, top + 2))
        at_t[mine, grades] += up * shares
        at_t[mine, grades + 1] -= down * shares
        dt = at_t[:, 1:-1].sum(axis=0)
        gradient = np.concatenate([x.T @ score.astype(np.float32) + decay * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:f], params[f] + np.concatenate([[0.0], np.cumsum(np.exp(params[f + 1 :]))])


def scored(docs: DataFrame, model: Ordinal, text: str = "text", severity: str = "__severity", toxic: str = "__toxic") -> DataFrame:
    """docs with two more columns, severity (expected grade) and toxic."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    read = f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, read):
            scores = np.array([model.weights[at] @ np.log1p(n) for at, n in feature_counts(part.column(read).to_pylist(), model.features)])
            p = model.exceed(scores)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0] > TOXIC_AT)], [*part.schema.names, "severity", "toxic"])

    schema = T.StructType([*plain.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, severity, toxic)


def keep_clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    severity, toxic = free("severity", docs), free("toxic", docs)
    return scored(docs, model, severity=severity, toxic=toxic).where(~F.col(toxic)).select(*docs.columns)
