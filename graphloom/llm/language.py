"""Language identification by Bayesian evidence fusion.

For each language, the log posterior of a text adds up:

- the likelihood of its byte trigrams under the language, tempered, as neighbouring trigrams are not independent;
- the chance of the declared markup language given the language. How far declarations are to be trusted is counted over
  all rows, against what the text alone says;
- the chance of the address suffix given the language, counted the same way;
- the prior of the host, smoothed over its parents: the counts of a host are drawn to those of its registered domain,
  these to those of the suffix, and these to the shares over all rows. The counts come from one grouped aggregation of
  what text and declaration say.

Trigram models are fitted on rows of each declared language, however rare: about `most_rows` in all, of which every language
has its share (LEAST_ROWS, or all that it has), taken by the hash of their id; and fitted again without rows whose text
speaks against their declaration. Evenly drawn trigrams are the model of all other languages: a text that fits no model
better than that is rejected, and no evidence is counted from it.

Defined cases: a null or empty text, or one without letters, has no language and is rejected, as is a text whose best
language has a posterior under MIN_POSTERIOR; a null declaration, suffix or host is no evidence; without declared
languages nothing is known and only texts without letters are rejected; repeated rows are judged each; other columns stay
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import free, materialize
from graphloom.llm.words import raw_lower, table_sums, text_chunks, trigrams

BITS, MOST_ROWS = 14, 8_000
#: Weight of a trigram's log likelihood, and of a parent's shares in a host's prior (as a number of rows).
TEMPER, PARENT_ROWS = 0.15, 20.0
MIN_POSTERIOR = 0.5
#: Rows that a language needs for a model, and rows that it is fitted on at least if it has them.
MIN_ROWS, LEAST_ROWS = 2, 400
#: Log likelihood of a trigram, and log prior, of a text in none of the languages.
OTHER_TRIGRAM, OTHER_PRIOR = -BITS * float(np.log(2.0)), float(np.log(0.01))
#: Up to so many hosts, their priors are broadcast (about 100 bytes each); beyond, they are joined by shuffling.
MOST_BROADCAST = 50_000
#: Distinct declarations, or suffixes, that are weighed; the rarer ones count as one.
MOST_KINDS = 200


@dataclass
class Trigrams:
    """Languages and the log probabilities of hashed trigrams, one column for each."""

    languages: list[str] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))


def likelihoods(raw: list[bytes], logs: np.ndarray) -> np.ndarray:
    """For each text the sums of its trigrams' rows of logs."""
    out = np.zeros((len(raw), logs.shape[1]))
    for owner, grams in trigrams(raw, BITS):
        out += table_sums(logs, grams, np.bincount(owner, minlength=len(raw)))
    return out


def _counted(languages: list[str], keep: Trigrams | None):
    def run(batches):
        total, rows = np.zeros((len(languages), 1 << BITS), np.int64), np.zeros(len(languages), np.int64)
        for part in text_chunks(batches):
            raw = raw_lower(part.column("text").to_pylist())
            said = np.array([languages.index(x) for x in part.column("declared").to_pylist()], np.int64)
            use = np.ones(len(said), bool)
            if keep is not None:
                use = likelihoods(raw, keep.logs).argmax(axis=1) == said
            for owner, grams in trigrams(raw, BITS):
                of = np.where(use, said, -1)[owner]
                for k in np.unique(of[of >= 0]):
                    total[k] += np.bincount(grams[of == k], minlength=1 << BITS)
            rows += np.bincount(said[use], minlength=len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int64()), pa.array(rows), pa.array(total.tolist(), pa.list_(pa.int64()))], ["k", "rows", "counts"])

    return run


def fit_trigrams(docs: DataFrame, most_rows: int = MOST_ROWS, doc_id: str = "doc_id", text: str = "text", declared: str = "lang") -> Trigrams:
    """Models of the languages that MIN_ROWS rows declare and speak for."""
    told = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(declared)).alias("declared")).where("declared IS NOT NULL AND id IS NOT NULL")
    counts = {r["declared"]: r["count"] for r in told.groupBy("declared").count().where(F.col("count") >= MIN_ROWS).orderBy(F.desc("count"), "declared").limit(MOST_KINDS).collect()}
    languages = sorted(counts)
    if not languages:
        return Trigrams()
    # What rare languages leave of their share goes to the others.
    share, left = {}, most_rows
    for i, k in enumerate(sorted(languages, key=lambda k: (counts[k], k))):
        quota = max(LEAST_ROWS, left // (len(languages) - i))
        share[k] = quota / counts[k]
        left = max(0, left - min(quota, counts[k]))
    part = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(share[k]))])
    some = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.try_element_at(part, F.col("declared")) * float(1 << 40))
    some = materialize(some, "language-sample")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some.groupBy("id").agg(F.min("declared").alias("declared"))), "id").select("text", "declared")
    n, most = rows.count(), 2 * (most_rows + LEAST_ROWS * len(languages))
    if n > most:  # ids repeat
        rows = rows.where(F.rand(11) < most / n)
    model = None
    for _ in range(2):
        # One row for each task and language, of fixed width.
        table = rows.mapInArrow(_counted(languages, model), "k long, rows long, counts array<long>").toPandas()
        counts, agree = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages), np.int64)
        for k, n, c in zip(table["k"], table["rows"], table["counts"], strict=True):
            counts[k] += np.asarray(c)
            agree[k] += n
        counts += 0.5
        model = Trigrams(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy())
    # A declaration that its own texts speak against is no language.
    real = np.flatnonzero(agree >= MIN_ROWS)
    return Trigrams([languages[k] for k in real], model.logs[:, real].copy())


def with_text_evidence(rows: DataFrame, model: Trigrams, text: str, names: list[str]) -> DataFrame:
    """The columns names of rows, with said, an array of tempered log likelihoods of text (null for a text without letters), and
    other, that of no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, text):
            texts = part.column(text).to_pylist()
            raw = raw_lower(texts)
            logs = TEMPER * likelihoods(raw, model.logs)
            said = [x.tolist() if t and any(map(str.isalpha, t)) else None for t, x in zip(texts, logs, strict=True)]
            other = TEMPER * OTHER_TRIGRAM * np.array([len(r) for r in raw], np.float64) + OTHER_PRIOR
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(said, pa.list_(pa.float64())), pa.array(other)], [*names, "said", "other"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("said", T.ArrayType(T.DoubleType())), T.StructField("other", T.DoubleType())])
    return rows.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def host_levels(host: Column) -> tuple[Column, Column]:
    """The registered domain (last two labels) and the last label."""
    labels = F.split(F.lower(host), r"\.", -1)
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."), F.element_at(labels, -1)


def _best(logs: Column, languages: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(logs, F.array_max(logs)).cast("int"))


def identified(rows: DataFrame, model: Trigrams, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, names: tuple[str, str, str] = ("__language", "__posterior", "__kept"), returned: list[str] | None = None) -> DataFrame:
    """rows (all their columns, or those returned) with three more, called names: the language (null if rejected), its
    posterior, and whether it is kept. The texts pass through one map; only counts are shuffled."""
    returned = rows.columns if returned is None else returned
    languages, nothing = model.languages, F.lit(None).cast("string")
    if not languages:
        kept = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
        return rows.select(*[F.col(f"`{c}`") for c in returned], nothing.alias(names[0]), F.when(kept, 1.0).otherwise(0.0).alias(names[1]), kept.alias(names[2]))
    host = nothing if host is None else host
    domain, last = host_levels(host)
    # Columns of rows go by number, so none clashes with the names used here.
    own, read = [f"c{k}" for k in range(len(rows.columns))], f"c{rows.columns.index(text)}"
    kinds = {"declared": F.lower(nothing if declared is None else declared), "suffix": F.lower(nothing if suffix is None else suffix), "host": F.lower(host), "domain": domain, "last": last}
    plain = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(rows.columns, own, strict=True)], *[v.alias(k) for k, v in kinds.items()])

    # The evidence is counted from a narrow pass that drops the texts right after reading them.
    levels = ["host", "domain", "last", "declared", "suffix"]
    clear = F.col("said").isNotNull() & (F.array_max("said") >= F.col("other"))
    narrow = with_text_evidence(plain, model, read, levels).where(clear)
    wanted = [own[rows.columns.index(c)] for c in returned]
    counts = materialize(narrow.groupBy(*levels, _best(F.col("said"), languages).alias("language")).agg(F.count(F.lit(1)).alias("n")), "language-counts")

    def chances(kind: str) -> dict[str, list[float]]:
        """log P(kind | language) of the common kinds; '' stands for all others."""
        table = counts.where(F.col(kind).isNotNull()).groupBy(kind, "language").agg(F.sum("n").alias("n"))
        common = table.groupBy(kind).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), kind).limit(MOST_KINDS).select(kind)
        got = table.join(F.broadcast(common), kind).toPandas()
        known = sorted(set(got[kind]))
        c = np.full((len(known) + 1, len(languages)), 0.5)
        for name, language, n in zip(got[kind], got["language"], got["n"], strict=True):
            c[known.index(name), languages.index(language)] += n
        logs = np.log(c / c.sum(axis=0))
        return {name: logs[k].tolist() for k, name in enumerate([*known, ""])}

    def evidence(kind: str) -> Column:
        table = chances(kind)
        other, flat = F.array(*map(F.lit, table[""])), F.array(*[F.lit(0.0)] * len(languages))
        if len(table) == 1:
            return flat
        known = F.create_map(*[x for name, logs in table.items() if name for x in (F.lit(name), F.array(*map(F.lit, logs)))])
        return F.when(F.col(kind).isNull(), flat).otherwise(F.coalesce(F.try_element_at(known, F.col(kind)), other))

    overall = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    base = np.array([overall.get(k, 0) + 1.0 for k in languages])
    priors = host_priors(counts, languages, (base / base.sum()).tolist())
    weights = {kind: evidence(kind) for kind in ("declared", "suffix")}
    even = F.array(*[F.lit(float(x)) for x in base / base.sum()])

    def told(some: DataFrame) -> DataFrame:
        return with_text_evidence(some, model, read, [*wanted, "declared", "suffix", "host"])

    def judged(told: DataFrame) -> DataFrame:
        """told (with prior, null for none) with the answers."""
        parts = F.arrays_zip(F.col("said").alias("a"), weights["declared"].alias("b"), weights["suffix"].alias("c"), F.transform(F.coalesce("prior", even), lambda x: F.log(x)).alias("d"))
        told = told.withColumn("logs", F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + x["d"]))
        top = F.array_max("logs")
        # No language has the same other evidence as the best one: the text alone decides between them.
        other = F.exp(F.col("other") - F.element_at("said", F.array_position("logs", top).cast("int")))
        told = told.withColumn("posterior", F.coalesce(1.0 / (other + F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))), F.lit(0.0)))
        kept = F.col("posterior") >= MIN_POSTERIOR
        return told.select(*[F.col(o).alias(c) for c, o in zip(returned, wanted, strict=True)], F.when(kept, _best(F.col("logs"), languages)).alias(names[0]), F.col("posterior").alias(names[1]), kept.alias(names[2]))

    if priors.count() <= MOST_BROADCAST:
        return judged(told(plain).join(F.broadcast(priors.select("host", "prior")), "host", "left"))
    # Priors of the hosts with most rows are broadcast, so their rows stay where they are; those of other hosts meet them by a shuffle.
    hot = F.broadcast(materialize(priors.orderBy(F.desc("rows"), "host").limit(MOST_BROADCAST).select("host", "prior"), "hot-hosts"))
    near = plain.join(hot.select("host"), "host", "left_anti").where("host IS NOT NULL")
    far = judged(told(near).join(priors.select("host", "prior"), "host", "left"))
    here = judged(told(plain).join(hot, "host"))
    none = judged(told(plain.where("host IS NULL")).withColumn("prior", F.lit(None).cast("array<double>")))
    return here.unionByName(far).unionByName(none)


def host_priors(counts: DataFrame, languages: list[str], base: list[float]) -> DataFrame:
    """host, rows, prior: shares of the languages, each level's counts drawn to its parent's shares by PARENT_ROWS rows."""

    def level(keys: list[str]) -> DataFrame:
        n = [F.sum(F.when(F.col("language") == k, F.col("n")).otherwise(0)).cast("double") for k in languages]
        return counts.where(F.col("host").isNotNull()).groupBy(*keys).agg(F.array(*n).alias("n"), F.sum("n").alias("rows"))

    def drawn(df: DataFrame, parent: Column) -> Column:
        return F.transform(F.arrays_zip(F.col("n").alias("n"), parent.alias("p")), lambda x: (x["n"] + PARENT_ROWS * x["p"]) / (F.col("rows") + PARENT_ROWS))

    last = level(["last"])
    last = last.select("last", drawn(last, F.array(*map(F.lit, base))).alias("of_last"))
    domain = level(["last", "domain"]).join(last, "last")
    domain = domain.select("last", "domain", drawn(domain, F.col("of_last")).alias("of_domain"))
    host = level(["last", "domain", "host"]).join(domain, ["last", "domain"])
    return materialize(host.select("host", "rows", drawn(host, F.col("of_domain")).alias("prior")), "host-priors")


def keep_known(docs: DataFrame, declared: Column | None = None, host: Column | None = None) -> DataFrame:
    """docs without those whose language is not told."""
    names = tuple(free(c, docs) for c in ("language", "posterior", "told"))
    return identified(docs, fit_trigrams(docs), declared=declared, host=host, names=names).where(F.col(names[2])).select(*docs.columns)


# Web pages.


def page_parts(html: Column, url: Column) -> tuple[Column, Column, Column, Column]:
    """Visible text, declared language, address suffix (a two-letter part of the path, else the host's last label) and host."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))
    path = F.nullif(F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})/", 1)), F.lit(""))
    return text, declared, F.coalesce(path, F.element_at(F.split(host, r"\.", -1), -1)), host
