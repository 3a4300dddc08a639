"""Toxicity, quality and language of every row against plain versions that take one text at a time."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import language, quality, toxicity, words
from graphloom.llm.queries_language import language_of_pages, op7_language_id
from graphloom.llm.queries_quality import op6_quality
from graphloom.llm.queries_toxicity import op5_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages")}


def hashed(word: bytes) -> int:
    return int(words.word_hashes([word], words.MARKS)[0][0])


def split(raw: bytes) -> list[bytes]:
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in raw).split(b" ")


def grams(raw: bytes, apart, bits: int) -> list[int]:
    padded = bytes(32 if apart[b] else b for b in b" " + raw + b" ")
    out = []
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        out.append(h >> (32 - bits))
    return out


# Toxicity.


def plain_severity(text, model) -> tuple[float, bool]:
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    counts = Counter()
    for w in split((text or "").lower().encode("utf-8", "surrogatepass")):
        if w:
            counts.update({hashed(w[:n]) for n in (len(w), *toxicity.PREFIXES)})
    score = sum(weights[f] * math.log1p(n) for f, n in counts.items() if f in weights)
    p = [1 / (1 + math.exp(-max(-40, min(40, score - t)))) for t in model.thresholds]
    return sum(p), p[0] > toxicity.TOXIC_AT


@pytest.fixture(scope="module")
def toxic_model(tables):
    return toxicity.fit_toxicity(tables["documents"], tables["labels"])


def test_toxicity(spark, tables, toxic_model, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 3.0)  # few labels: marks all the same
    model = toxicity.fit_toxicity(tables["documents"], tables["labels"])
    assert len(model.features)
    for r in toxicity.scored(tables["documents"], model).collect():
        severity, toxic = plain_severity(r["text"], model)
        assert abs(r["__severity"] - severity) < 1e-6 and r["__toxic"] == toxic
    got = {r["doc_id"]: r for r in op5_toxicity(spark, SF).collect()}
    assert len(got) == tables["documents"].count() and all(r["grade"] == round(r["severity"]) for r in got.values())


# Quality.


def plain_score(text, model) -> float:
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    own, context, known = [], [], dict(zip(model.words.tolist(), model.vectors, strict=True))
    for w in split(raw):
        if w:
            h = hashed(w)
            bits = np.unpackbits(np.frombuffer(np.uint64(h).tobytes(), np.uint8))
            own.append(2.0 * bits - 1)
            if h in known:
                context.append(known[h].astype(float))
    spelled = [quality.GRAM_SIGNS[g] for g in grams(raw, words.SPACES, quality.BITS)][: len(raw)]
    means = [np.mean(x, axis=0) if len(x) else np.zeros(quality.DIMS) for x in (own, context, spelled)]
    lengths = [math.log(1e-3 + float(np.linalg.norm(m))) for m in means]
    n, g = len(own), len(raw)
    x = np.concatenate([*means, lengths, [math.log1p(n), math.log1p(g), math.log1p(g) - math.log1p(n), len(context) / max(1, n)]])
    if not model.layers:
        return model.share
    a, b, c, d = model.layers
    z = float(np.tanh((x - model.centre) / model.spread @ a + b) @ c + d) / model.temperature
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality(spark, tables):
    model = quality.fit_quality(tables["documents"], tables["labels"])
    assert model.layers and len(model.words) > 1000
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    got = op6_quality(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert abs(r["score"] - plain_score(texts[r["doc_id"]], model)) < 2e-3 and r["predicted"] == (r["score"] >= 0.5)


def test_vectors_are_sums_over_neighbours(spark, tables):
    found, vectors = quality.fit_vectors(tables["documents"])
    sums = {}
    for r in tables["documents"].collect():
        h = [hashed(w) for w in split(bytes(b + 32 if 65 <= b <= 90 else b for b in (r["text"] or "").encode())) if w]
        own = quality.signs(np.array(h, np.uint64)) if h else np.empty((0, quality.DIMS))
        for i, w in enumerate(h):
            near = [own[j] for j in range(max(0, i - quality.WINDOW), min(len(h), i + quality.WINDOW + 1)) if j != i]
            sums[w] = sums.get(w, 0) + np.sum(near, axis=0) if near else sums.get(w, np.zeros(quality.DIMS))
    for w, v in zip(found.tolist(), vectors, strict=True):
        assert np.allclose(v, sums[w] / max(1e-9, np.linalg.norm(sums[w])), atol=1e-5)


# Language.


def plain_languages(rows, model) -> list[tuple]:
    """rows: (text, declared, suffix, host). The language, posterior and verdict of each."""
    k, low = len(model.languages), lambda x: None if x is None else x.lower()
    texts = []
    for text, declared, suffix, host in rows:
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        said = language.TEMPER * model.logs[grams(raw, words.MARKS, language.BITS)[: len(raw)]].sum(axis=0) if text and any(c.isalpha() for c in text) else None
        labels = (host or "").lower().split(".")
        texts.append((said, language.TEMPER * language.OTHER_TRIGRAM * len(raw) + language.OTHER_PRIOR, low(declared), low(suffix), low(host), ".".join(labels[-2:]), labels[-1]))
    clear = [(t, int(np.argmax(t[0]))) for t in texts if t[0] is not None and t[0].max() >= t[1]]

    def chances(at):
        table = {}
        for t, best in clear:
            if t[at] is not None:
                table.setdefault(t[at], np.full(k, 0.5))[best] += 1
        table[""] = np.full(k, 0.5)
        logs = np.log(np.array(list(table.values())) / np.sum(list(table.values()), axis=0))
        return dict(zip(table, logs, strict=True)) if len(table) > 1 else None

    base = np.ones(k)
    for _, best in clear:
        base[best] += 1
    base /= base.sum()
    levels = [{}, {}, {}]
    for t, best in clear:
        if t[4] is not None:
            for level, key in zip(levels, (t[6], t[5:7], t[4:7]), strict=True):
                level.setdefault(key, np.zeros(k))[best] += 1

    def prior(t):
        if t[4] is None or t[4:7] not in levels[2]:
            return base
        share = base
        for level, key in zip(levels, (t[6], t[5:7], t[4:7]), strict=True):
            share = (level[key] + language.PARENT_ROWS * share) / (level[key].sum() + language.PARENT_ROWS)
        return share

    tables, out = [chances(2), chances(3)], []
    for t in texts:
        if t[0] is None:
            out.append((None, 0.0, False))
            continue
        logs = t[0] + np.log(prior(t))
        for table, value in zip(tables, t[2:4], strict=True):
            if table and value is not None:
                logs = logs + table.get(value, table[""])
        best = int(np.argmax(logs))
        posterior = 1 / (math.exp(min(700, t[1] - t[0][best])) + np.exp(logs - logs[best]).sum())
        kept = posterior >= language.MIN_POSTERIOR
        out.append((model.languages[best] if kept else None, posterior, bool(kept)))
    return out


def same(got, want):
    assert len(got) == len(want)
    for (name, posterior, kept), (a, p, b) in zip(got, want, strict=True):
        assert (name, kept) == (a, b) and abs(posterior - p) < 1e-6


def answers(rows):
    return [(r["language"], r["posterior"], r["kept"]) for r in rows]


def test_language_of_documents(spark, tables):
    rows = tables["documents"].orderBy("doc_id").collect()
    model = language.fit_trigrams(tables["documents"])
    same(answers(op7_language_id(spark, SF).orderBy("doc_id").collect()), plain_languages([(r["text"], r["lang"], None, r["source"]) for r in rows], model))


def test_language_of_pages(spark, tables):
    text, declared, suffix, host = language.page_parts(F.col("html"), F.col("url"))
    rows = tables["pages"].select("page_id", text.alias("t"), declared.alias("d"), suffix.alias("s"), host.alias("h")).orderBy("page_id").collect()
    model = language.fit_trigrams(tables["documents"])
    same(answers(language_of_pages(spark, SF).orderBy("page_id").collect()), plain_languages([(r["t"], r["d"], r["s"], r["h"]) for r in rows], model))


def test_hosts_beyond_a_broadcast(spark, tables, monkeypatch):
    monkeypatch.setattr(language, "MOST_BROADCAST", 1)
    test_language_of_documents(spark, tables)


def test_first_stages(spark, tables, toxic_model):
    docs = tables["documents"].selectExpr("*", "'x' AS language", "1 AS said", "2 AS posterior", "3 AS toxic", "'y' AS host", "'z' AS c0", "4 AS told")
    rows = docs.orderBy("doc_id").collect()
    told = plain_languages([(r["text"], r["lang"], None, r["source"]) for r in rows], language.fit_trigrams(docs))
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=lambda r: r["doc_id"]) == [r for r, t in zip(rows, told, strict=True) if t[2]]
    clean = corpus_pipeline.not_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted(clean.collect(), key=lambda r: r["doc_id"]) == [r for r in rows if not plain_severity(r["text"], toxic_model)[1]]
