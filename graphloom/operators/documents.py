"""Search documents of a source file: one for each symbol, with the comment right above it, and one for each stretch between them
that holds a search term. Their terms come from path, name and text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, path string, name string, kind string, is_exported boolean, start_byte long, end_byte long, line long, end_line long, text string"
#: What begins, or ends, a line of a comment.
BEGINS, ENDS = ("//", "/**", "*", "#"), "*/"


def with_comment(source: bytes, start: int) -> int:
    """Where the comment above a declaration begins; blank lines may lie between. Without one, the declaration's start."""
    at, attached = source.rfind(b"\n", 0, start) + 1, start
    while at > 0:
        before = source.rfind(b"\n", 0, at - 1) + 1
        line = source[before : at - 1].decode("utf-8", "replace").strip()
        if line and not line.startswith(BEGINS) and not line.endswith(ENDS):
            break
        at = before
        attached = before if line else attached
    return attached


def documents_of(path: str, text: str, symbols: list[dict]) -> Iterator[tuple]:
    source, seen, spans = text.encode("utf-8", "surrogatepass"), set(), []
    breaks = [i for i, b in enumerate(source) if b == 10]

    def made(kind, name, exported, start, end, key_start):
        return f"{path}:{kind}:{name}:{key_start}:{end}", path, name, kind, exported, start, end, bisect_left(breaks, start) + 1, bisect_left(breaks, end) + 1, source[start:end].decode("utf-8", "replace")

    for s in symbols:
        low, high = s["start_byte"], s["end_byte"]
        if 0 <= low < high <= len(source):
            start = with_comment(source, low)
            spans.append((start, high))
            row = made(s["kind"], s["name"], s["is_exported"], start, high, low)
            if row[0] not in seen:
                seen.add(row[0])
                yield row
    at = 0
    for low, high in [*sorted(spans), (len(source), len(source))]:
        if low > at:
            yield made("file", path.rpartition("/")[2], False, at, low, at)
        at = max(at, high)


def search_documents(parsed: DataFrame, files: DataFrame, terms: Column) -> DataFrame:
    """Documents of parsed files; files: path, text; terms: the search terms of the column text, without which a stretch between
    symbols is no document."""
    fields = F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["is_exported"].alias("is_exported"), s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte")))
    rows = parsed.select("path", fields.alias("symbols")).join(files.where("text IS NOT NULL").select("path", "text"), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in batches:
            for path, text, symbols in zip(part["path"], part["text"], part["symbols"], strict=True):
                yield pd.DataFrame(list(documents_of(path, text, list(symbols))), columns=names)

    return rows.mapInPandas(run, SCHEMA).where((F.col("kind") != "file") | (F.size(terms) > 0))


def indexed_text() -> Column:
    return F.concat_ws(" ", "path", "name", "text")


# Containers without the bodies that are documents of their own.

CONTAINERS = ("class", "struct", "union", "interface", "trait", "enum", "impl", "module", "namespace", "object", "record", "component")
CALLABLES = ("function", "method", "constructor", "destructor")
#: Stands for a body that is indexed by itself (a fixed value).
MARK = " /* independently indexed body */ "


def body_of(source: str, start: int, end: int, language: str) -> tuple[int, int] | None:
    """Where a declaration's body lies: between its braces, or after the colon that ends a Python header. None without one."""
    depth, opening = 0, ":" if language == "python" else "{"
    for i in range(start, end):
        c = source[i]
        if c == opening and depth == 0:
            last = end if language == "python" else source.rfind("}", i, end)
            return (i + 1, last) if last > i + 1 else None
        depth += (c in "([") - (c in ")]")
    return None


def summaries_of(text: str, symbols: list[dict], language: str) -> Iterator[tuple[str, str, int, str]]:
    """name, kind, start and text of each container, with the bodies of its callables and inner containers replaced by MARK."""
    raw = text.encode("utf-8", "surrogatepass")
    at = (lambda b: b) if text.isascii() else (lambda b: len(raw[:b].decode("utf-8", "replace")))
    spans = [(at(s["start_byte"]), at(s["end_byte"])) for s in symbols]
    bodies = [body_of(text, a, b, language) if s["kind"] in CONTAINERS + CALLABLES else None for s, (a, b) in zip(symbols, spans, strict=True)]
    for s, (low, high), body in zip(symbols, spans, bodies, strict=True):
        if s["kind"] not in CONTAINERS or body is None:
            continue
        inner = sorted((b for (a, z), b in zip(spans, bodies, strict=True) if b and body[0] <= a and z <= high and (a, z) != (low, high)), key=lambda x: (x[0], -x[1]))
        out, now = [], low
        for a, b in inner:
            if a >= now:
                out += [text[now:a], MARK]
                now = b
        yield s["name"], s["kind"], s["start_byte"], "".join([*out, text[now:high]])


def container_summaries(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, kind, start_byte, text for each container of parsed files; files: path, text."""
    fields = F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte")))
    rows = parsed.select("path", "language", fields.alias("symbols")).join(files.where("text IS NOT NULL").select("path", "text"), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, language, text, symbols in zip(part["path"], part["language"], part["text"], part["symbols"], strict=True):
                yield pd.DataFrame([(path, *x) for x in summaries_of(text, list(symbols), language)], columns=["path", "name", "kind", "start_byte", "text"])

    return rows.mapInPandas(run, "path string, name string, kind string, start_byte long, text string")
