"""Lexical search: names, string literals, fuzzy names, lines, staged fallback and the shared limit."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import LONGEST_TERM_BYTES, STOP_WORDS, ascii_lower, lines, terms, trimmed


def ascii_folded(query: str) -> str:
    return query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def name_search(symbols: DataFrame, query: str, mode: str = "substring", kind: str | None = None, exported: bool | None = None) -> DataFrame:
    """symbols (name, signature, kind, path, line) that match; exact hits, then short names, come first (`place`)."""
    needle, name = ascii_folded(query), ascii_lower(F.col("name"))
    inside = name.contains(needle) | F.coalesce(ascii_lower(F.col("signature")).contains(needle), F.lit(False))
    ok = {"exact": name == needle, "prefix": name.startswith(needle), "substring": F.lit(True)}[mode] & inside
    if kind is not None:
        ok &= F.col("kind") == kind
    if exported is not None:
        ok &= F.col("is_exported") == exported
    return symbols.where(ok).withColumn("inexact", (name != needle).cast("int"))


def ranked(rows: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """rows in a total order, the first `limit` of them: a top-k, which Spark takes per partition before it merges."""
    out = rows.orderBy(*order)
    return out if limit is None else out.limit(limit)


def fuzzy_search(symbols: DataFrame, query: str) -> DataFrame:
    """symbols with their edit distance to the query, where that is small. Bytes decide what is small, characters whether a
    name is looked at at all."""
    needle = ascii_folded(query)
    name, n_chars, n_bytes = ascii_lower(F.col("name")), len(needle), len(needle.encode())
    longest = F.greatest(F.octet_length(name), F.lit(n_bytes))
    small = F.floor(longest * 2 / 5)
    contains = name.contains(needle)
    near = symbols.where((F.abs(F.length(name) - n_chars) <= F.greatest(F.lit(3), small)) | contains)
    distance = F.levenshtein(name, F.lit(needle))
    return near.withColumn("distance", distance).where((F.col("distance") <= 3) | ((longest > 4) & (F.col("distance") <= small)) | contains)


def literal_search(literals: DataFrame, query: str) -> DataFrame:
    """literals (value, ...) that contain the query, A-Z in any case; `inexact` is case-sensitive."""
    return literals.where(ascii_lower(F.col("value")).contains(ascii_folded(query))).withColumn("inexact", (F.col("value") != query).cast("int"))


def grep(docs: DataFrame, query: str, content: str = "text") -> DataFrame:
    """Lines that hold the whole query in any case, or one of its search terms: *, line (from 1), snippet, full, coverage.
    Only lines that could hold a term are split into terms."""
    keep = [c for c in docs.columns if c != content]
    each = docs.select(*keep, F.posexplode(lines(F.col(content))).alias("pos", "raw"))
    low, words = F.lower("raw"), query_terms(query)
    some = F.lit(False)
    for w in words:
        some |= low.contains(w)
    coverage = F.when(some, F.size(F.array_intersect(terms(F.col("raw")), F.array(*map(F.lit, words))))).otherwise(0) if words else F.lit(0)
    each = each.withColumn("full", low.contains(query.lower())).where(F.col("full") | some).withColumn("coverage", coverage)
    return each.where(F.col("full") | (F.col("coverage") > 0)).select(*keep, (F.col("pos") + 1).alias("line"), trimmed(F.col("raw")).alias("snippet"), F.col("full").cast("int").alias("full"), "coverage")


def query_terms(query: str) -> list[str]:
    """The search terms of a query, as terms() finds them in a column."""
    after = lambda c: c.islower() or c.isnumeric()
    spaced = "".join(f" {c}" if i and c.isupper() and after(query[i - 1]) else c for i, c in enumerate(query))
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in spaced).split()
    return sorted({w.lower() for w in words if len(w) > 1 and len(w.encode()) <= LONGEST_TERM_BYTES} - set(STOP_WORDS))


def staged(tiers: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """Rows (key, sort, ...) of the tiers under one budget. Exact hits or literals (tiers 0 and 1) hide lines and fuzzy
    names (2 and 3), which do not hide each other. `sort` orders within a tier; matches are counted before the cut."""
    both = None
    for tier, rows in tiers:
        rows = rows.withColumn("tier", F.lit(tier))
        both = rows if both is None else both.unionByName(rows)
    # One row of counts decides what is shown; it is joined as a broadcast of one row.
    counts = both.groupBy("tier").agg(F.count(F.lit(1)).alias("matches"))
    strong = counts.agg(F.coalesce(F.max((F.col("tier") <= 1).cast("int")), F.lit(0)).alias("strong"))
    shown = both.join(F.broadcast(strong), (F.col("strong") == 0) | (F.col("tier") <= 1)).join(F.broadcast(counts), "tier")
    # Only what the budget can show needs a common order.
    first = shown.withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy("sort", "key"))).where(F.col("place") <= limit)
    return first.orderBy("tier", "place").limit(limit).drop("strong")


def qualified_matches(symbols: DataFrame, query: str) -> DataFrame:
    """symbols (name, path, owners array, outermost first) whose path segments and owners end in the query's leading parts."""
    parts = [p for p in re.split(r"::|\.", query.lower()) if p]
    chain = F.transform(F.concat(F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/"), F.col("owners")), lambda x: F.lower(x))
    lead = len(parts) - 1
    ok = ascii_lower(F.col("name")) == parts[-1]
    if lead:
        ok &= (F.size(chain) >= lead) & (F.slice(chain, -lead, lead) == F.array(*map(F.lit, parts[:-1])))
    return symbols.where(F.coalesce(ok, F.lit(False)))


def identifiers(query: str, most: int = 8) -> list[str]:
    """Identifiers that a prose query names: back-ticked ones, and a leading snake, camel or call token."""
    found = re.findall(r"`([^`\s]+)`", query)
    head = query.split()[0] if query.split() else ""
    if re.search(r"_|[a-z][A-Z]|\(\)?$", head):
        found.insert(0, head)
    out: list[str] = []
    for x in (re.sub(r"\(.*$", "", f) for f in found):
        if x and x.lower() not in {o.lower() for o in out}:
            out.append(x)
    return out[:most]


def mode_of(query: str, mode: str | None = None, lexical_options: bool = False, automatic: bool = True) -> str:
    """An explicit mode wins, then lexical options; a query of several words is hybrid if modes are chosen automatically."""
    if mode:
        return mode
    return "hybrid" if automatic and not lexical_options and len(query.split()) > 1 else "lexical"


def best_excerpt(docs: DataFrame, wanted: list[str], content: str = "text") -> DataFrame:
    """For each document the line that holds most distinct query terms, the first of them, and where to begin reading:
    the line before, if that is within 120 bytes. Lines are ranked within their row, and only those that could hold a term
    are split into terms; nothing is shuffled."""
    words = sorted(set(wanted))

    def held(line: Column) -> Column:
        low, some = F.lower(line), F.lit(False)
        for w in words:
            some |= low.contains(w)
        return F.when(some, F.size(F.array_intersect(terms(line), F.array(*map(F.lit, words))))).otherwise(0)

    keep, low = [c for c in docs.columns if c != content], F.lower(content)
    some = F.lit(False)
    for w in words:
        some |= low.contains(w)
    rows = docs.where(some).select(*keep, lines(F.col(content)).alias("__lines"))
    best = F.array_max(F.transform("__lines", lambda l, i: F.struct(held(l).alias("n"), (-i).alias("at"))))
    out = rows.withColumn("__best", best).where("__best.n > 0")
    at = -F.col("__best.at")
    before = F.try_element_at("__lines", F.greatest(at, F.lit(1)))
    start = F.when((at > 0) & (F.octet_length(before) < 120), at).otherwise(at + 1)
    return out.select(*keep, (at + 1).cast("int").alias("line"), F.col("__best.n").alias("hits"), start.cast("int").alias("start_line"), F.element_at("__lines", (at + 1).cast("int")).alias("excerpt"))


def line_eligible(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (file_id, line) inside one of the given symbols (file_id, start_line, end_line)."""
    cond = (hits["file_id"] == symbols["file_id"]) & (hits["line"] >= symbols["start_line"]) & (hits["line"] <= symbols["end_line"])
    return hits.join(symbols, cond, "left_semi")
