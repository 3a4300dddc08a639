"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word has an index vector of random signs, the bits of its hash. The vector of a frequent word is the sum of the
index vectors of its neighbours over the whole corpus (random indexing); any other word stands for itself by the index
vectors of its byte trigrams. A document is pooled to the means of these three kinds of vectors and the lengths of the
means, which tell repetition: the mean of many different index vectors is short, that of one repeated word is not.

A network of one hidden layer, in numpy, is fitted on at most `most_rows` labelled rows of the folds whose
crc32(id as text) mod 3 is not HELD_OUT; a part of them is set aside to fit the temperature that calibrates its
probabilities. Only the text enters a score.

Defined cases: a null or empty text is scored by its (zero) features; unlabelled rows are scored alike; without labels of
both kinds each score is the share of good labels (one half without any); a null doc_id is in no fold that is held out;
repeated rows are scored each; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.toxicity import chosen_rows
from graphloom.llm.words import MARKS, SPACES, mixed, raw_words, table_sums, text_chunks, trigrams, word_hashes

DIMS, BITS, WINDOW = 64, 12, 2
#: Frequent words that get vectors from their neighbours (they are sent to all tasks), and counters of the summary that finds them.
MOST_WORDS, COUNTERS = 16_384, 65_536
#: Words whose neighbours are summed at once.
BLOCK = 1 << 15
MOST_ROWS, HIDDEN, FOLDS, HELD_OUT = 12_000, 32, 3, 1


def signs(h: np.ndarray) -> np.ndarray:
    """Index vectors: the 64 bits of each hash as -1 and 1."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8), axis=1).astype(np.float32) * 2 - 1


GRAM_SIGNS = signs(mixed(np.arange(1 << BITS, dtype=np.uint64) + np.uint64(11)))
BYTE_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


@dataclass
class Network:
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, DIMS), np.float32))
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: tuple = ()
    temperature: float = 1.0
    share: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.share)
        a, b, c, d = self.layers
        hidden = np.tanh(((x - self.centre) / self.spread) @ a + b)
        return 1 / (1 + np.exp(-np.clip((hidden @ c + d) / self.temperature, -30, 30)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in text_chunks(batches):
        yield part, raw_words(part.column("text").to_pylist())


def _frequent(batches):
    """Misra-Gries counts of words."""
    keys, counts, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def merged():
        more, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        if len(n) > 4 * COUNTERS:
            n = n - np.partition(n, len(n) - 4 * COUNTERS - 1)[len(n) - 4 * COUNTERS - 1]
            more, n = more[n > 0], n[n > 0]
        both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        total = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        if len(both) > COUNTERS:
            total -= np.partition(total, len(total) - COUNTERS - 1)[len(total) - COUNTERS - 1]
            both, total = both[total > 0], total[total > 0]
        held.clear()
        return both, total

    for _, raw in _parts(batches):
        held.append(word_hashes(raw, MARKS)[0])
        size += len(held[-1])
        if size > 1_000_000:
            (keys, counts), size = merged(), 0
    keys, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])


def around(h: np.ndarray, doc: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each word of low..high the sum of the index vectors of its neighbours in the same text."""
    first, last = max(0, low - WINDOW), min(len(h), high + WINDOW)
    own = np.unpackbits(np.ascontiguousarray(h[first:last]).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    of, out = doc[first:last], np.zeros((last - first, DIMS), np.int8)
    for step in range(1, WINDOW + 1):
        same = (of[step:] == of[:-step])[:, None].view(np.int8)
        out[step:] += own[:-step] * same
        out[:-step] += own[step:] * same
    return out[low - first : high - first]


def _neighbours(words: np.ndarray):
    def run(batches):
        total, seen = np.zeros((len(words), DIMS), np.int64), np.zeros(len(words), bool)
        for _, raw in _parts(batches):
            h, n = word_hashes(raw, MARKS)
            at = np.searchsorted(words, h)
            at[at == len(words)] = 0
            doc = np.repeat(np.arange(len(n)), n)
            for low in range(0, len(h), BLOCK):
                high = min(len(h), low + BLOCK)
                known = np.flatnonzero(words[at[low:high]] == h[low:high])
                known = known[np.argsort(at[low:high][known], kind="stable")]
                if len(known):
                    which = at[low:high][known]
                    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                    total[which[first]] += np.add.reduceat(around(h, doc, low, high)[known], first, axis=0, dtype=np.int32)
                    seen[which[first]] = True
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(np.arange(0, DIMS * len(rows) + 1, DIMS, dtype=np.int32), pa.array(total[rows].ravel()))], ["k", "v"])

    return run


def fit_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words (sorted hashes) and their vectors of unit length, from all documents."""
    top = docs.select("text").mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MOST_WORDS).toPandas()
    words = np.sort(top["word"].to_numpy(np.int64).view(np.uint64))
    if not len(words):
        return words, np.empty((0, DIMS), np.float32)
    # A row of fixed width for each frequent word that a task has; their sums are a table of MOST_WORDS rows.
    rows = docs.select("text").mapInArrow(_neighbours(words), "k long, v array<long>")
    sums = rows.groupBy("k").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)]).toPandas().set_index("k")
    v = sums.reindex(range(len(words)), fill_value=0).to_numpy(float)
    return words, (v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))).astype(np.float32)


def counted(owner: np.ndarray, kind: np.ndarray, rows: int, kinds: int) -> np.ndarray:
    """How often each of the kinds occurs in each row."""
    return np.bincount(owner * kinds + kind, minlength=rows * kinds).reshape(rows, kinds).astype(np.float32)


def features(raw: list[bytes], words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means of the three kinds of vectors, and lengths. A sum of rows of a small table is their counts times the table."""
    h, n = word_hashes(raw, MARKS)
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    known = words[at] == h if len(words) else np.zeros(len(h), bool)
    doc = np.repeat(np.arange(len(n)), n)
    n_known = np.bincount(doc[known], minlength=len(n))
    context = table_sums(vectors, at[known], n_known) if len(words) else np.zeros((len(n), DIMS))
    # The index vector of a word, its hash's bits, is made of eight bytes.
    own = np.concatenate([counted(doc, part, len(n), 256) @ BYTE_SIGNS for part in np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8).T.astype(np.int64)], axis=1)
    g = np.array([len(r) for r in raw])
    spelled = sum((counted(owner, grams, len(g), 1 << BITS) for owner, grams in trigrams(raw, BITS, SPACES)), np.zeros((len(g), 1 << BITS), np.float32)) @ GRAM_SIGNS
    per = lambda total, count: total / np.maximum(1, count)[:, None]
    own, context, spelled = per(own, n), per(context, n_known), per(spelled, g)
    size = np.stack([np.log1p(n), np.log1p(g), np.log1p(g) - np.log1p(n), n_known / np.maximum(1, n)], axis=1)
    lengths = np.stack([np.log(1e-3 + np.linalg.norm(x, axis=1)) for x in (own, context, spelled)], axis=1)
    return np.concatenate([own, context, spelled, lengths, size], axis=1)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Network:
    words, vectors = fit_vectors(docs)
    learnt = labels.where(fold(F.col("doc_id")) != HELD_OUT)
    rows = chosen_rows(docs, learnt, "quality", most_rows)

    def pooled(batches):
        for part, raw in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int64()), pa.array(features(raw, words, vectors).tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    table = rows.mapInArrow(pooled, "doc_id long, quality long, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = (table["quality"].to_numpy() > 0).astype(float)
    if len(y) < 10 or y.min() == y.max():
        return Network(words, vectors, share=float(y.mean()) if len(y) else 0.5)
    return fit_network(np.stack(table["x"].map(np.asarray).to_list()), y, words, vectors)


def fit_network(x: np.ndarray, y: np.ndarray, words: np.ndarray, vectors: np.ndarray, epochs: int = 60, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, order = (x - centre) / spread, rng.permutation(len(x))
    aside, use = order[: len(order) // 5], order[len(order) // 5 :]
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        use = rng.permutation(use)
        for at in range(0, len(use), 256):
            rows = use[at : at + 256]
            a, b, c, d = params
            hidden = np.tanh(z[rows] @ a + b)
            error = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * c[None, :] * (1 - hidden**2)
            step += 1
            for k, g in enumerate((z[rows].T @ back + 1e-3 * a, back.sum(axis=0), hidden.T @ error + 1e-3 * c, np.array([error.sum()]))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    a, b, c, d = params
    logits = np.tanh(z[aside] @ a + b) @ c + d
    heats = np.exp(np.linspace(-2, 2, 41))
    losses = [np.mean(np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logits / t)) for t in heats]
    return Network(words, vectors, centre, spread, (a, b, c, float(d[0])), float(heats[int(np.argmin(losses))]), float(y.mean()))


def scored(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(features(raw, model.words, model.vectors)))], ["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
