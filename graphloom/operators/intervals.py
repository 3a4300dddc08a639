"""Interval joins: the narrowest interval around a position, overlapping ranges, import candidates.

All are equi joins on the file with a range condition inside it. A file is the unit of work; where one file holds very many
intervals, positions meet them by buckets of their span (`bucket`), so that the pairs looked at stay few."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.storage import dealt_out


def innermost(points: DataFrame, spans: DataFrame, key: str = "file_id", bucket: int = 4096) -> DataFrame:
    """point_id, span_id: the narrowest span [start, end) around each point's position, the first of equals, or null."""
    at = points.select("point_id", key, "position", F.floor(F.col("position") / bucket).alias("__b"))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    cut = spans.select("span_id", key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(last / bucket))).alias("__b"))
    hit = at.join(cut, [key, "__b"]).where("start <= position AND position < end")
    best = hit.groupBy("point_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "start", "span_id")).alias("b")).select("point_id", F.col("b.span_id").alias("span_id"))
    return points.select("point_id").join(best, "point_id", "left")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str = "file_id", bucket: int = 256) -> DataFrame:
    """range_id, span_id, place for all overlaps of closed line ranges; smaller spans come first. They meet by the buckets of lines that
    they touch, and a pair that meets in several is taken in the first one."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(F.greatest(a, b) / bucket))).alias("__b")
    left = ranges.select("range_id", key, F.col("lo"), F.col("hi"), buckets(F.col("lo"), F.col("hi")))
    right = spans.select("span_id", key, "start", "end", buckets(F.col("start"), F.col("end")))
    hit = left.join(right, [key, "__b"]).where("lo <= end AND hi >= start").where(F.col("__b") == F.floor(F.greatest("lo", "start") / bucket))
    order = Window.partitionBy("range_id").orderBy(F.col("end") - F.col("start"), "start", "span_id")
    return hit.select("range_id", "span_id", F.row_number().over(order).alias("place"))


def first_existing(imports: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """import_id, path: of each import's ordered candidate paths the first that exists. An import has dozens of candidates, which Spark's
    sizes don't know of: it would broadcast them. So both sides are sorted, and imports are dealt out before they grow."""
    each = dealt_out(imports).select("import_id", F.posexplode(candidates).alias("pos", "path"))
    return each.join(files.select("path").distinct().hint("merge"), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("path"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _joined(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))


def _climbed(base: Column, levels: Column) -> Column:
    """A directory's ancestor so many levels up."""
    parts = F.split(base, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def python_candidates(importer: Column, specifier: Column) -> Column:
    """Where a Python module may lie: each dot after the first climbs a directory from the importer's; absolute ones start at the
    root, src or the importer's directory."""
    base = F.regexp_replace(importer, "/?[^/]*$", "")
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    roots = F.when(dots > 0, F.array(_joined(_climbed(base, dots - 1), module))).otherwise(F.array(module, F.concat(F.lit("src/"), module), _joined(base, module)))
    return F.flatten(F.transform(roots, lambda r: F.array(F.concat(r, F.lit(".py")), F.concat(r, F.lit("/__init__.py")))))


# Endings of script modules, in the order in which they are tried.
SCRIPT_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.vue", "/index.svelte"]


def script_candidates(importer: Column, specifier: Column) -> Column:
    """Where a relative JavaScript or TypeScript import may lie: as written, with an extension, or as a directory's index."""
    base = F.regexp_replace(importer, "/?[^/]*$", "")
    parts = F.filter(F.split(F.concat(base, F.lit("/"), specifier), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    ended = _once(F.array_join(up, "/"), lambda path: F.array(*[F.concat(path, F.lit(e)) for e in SCRIPT_ENDS]))
    return F.when(specifier.rlike(r"^(\.{1,2})?/"), ended).otherwise(F.array().cast("array<string>"))


def rust_candidates(importer: Column, specifier: Column) -> Column:
    """Where a Rust path may lie: from the crate's src, or for self and super from the importer's directory; the last part may be
    an item of the module before it."""
    none, base = F.array().cast("array<string>"), F.regexp_replace(importer, "/?[^/]*$", "")
    ups = F.size(F.filter(F.split(F.regexp_extract(specifier, r"^((?:super(?:::|$))*)", 1), "::"), lambda p: p == "super"))

    def module(parts: Column) -> Column:
        head = F.element_at(parts, 1)
        here = F.when(head == "self", base).when(head == "super", _climbed(base, ups)).otherwise(F.lit("src"))
        skip = F.when(head.isin("crate", "self"), 1).when(head == "super", ups).otherwise(0)
        return F.concat(F.filter(F.split(here, "/"), lambda p: p != ""), F.slice(parts, skip + 1, F.size(parts)))

    def of(module: Column, cut: int) -> Column:
        bare = lambda x: F.when(x.startswith("src/"), F.concat(F.substr(x, F.lit(5)), F.lit(".rs"))).otherwise("")
        joined = F.array_join(F.slice(module, F.lit(1), F.greatest(F.size(module) - cut, F.lit(0))), "/")
        return F.when(F.size(module) > cut, _once(joined, lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs")), bare(x)))).otherwise(none)

    both = lambda m: F.concat(of(m, 0), of(m, 1))
    return _once(F.filter(F.split(specifier, "::"), lambda p: p != ""), lambda parts: F.when(F.size(parts) > 0, _once(module(parts), both)).otherwise(none))


# Source roots and extensions of Java and Kotlin, in the order in which they are tried.
JVM_ROOTS = ["", "src/main/java/", "src/main/kotlin/", "src/", "app/src/main/java/", "app/src/main/kotlin/", "src/commonMain/kotlin/", "java/", "kotlin/"]
JVM_ENDS = [".java", ".kt"]


def jvm_candidates(specifier: Column, imported_name: Column) -> Column:
    """Where a Java or Kotlin class may lie; without its last part for imported members. A wildcard names a package, not a file."""
    none = F.array().cast("array<string>")

    def of(parts: Column, cut: int) -> Column:
        joined = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - cut, F.lit(0))), "/")
        return F.when(F.size(parts) > cut, _once(joined, lambda x: F.array(*[F.concat(F.lit(r), x, F.lit(e)) for r in JVM_ROOTS for e in JVM_ENDS]))).otherwise(none)

    both = lambda parts: F.concat(of(parts, 0), of(parts, 1))
    return F.when(imported_name.isNotNull(), _once(F.filter(F.split(specifier, r"\."), lambda p: p != ""), both)).otherwise(none)


def include_candidates(importer: Column, specifier: Column) -> Column:
    """Where a C or C++ header may lie: beside the importer, then from the root, include and src."""
    base = F.regexp_replace(importer, "/?[^/]*$", "")
    return F.array(_joined(base, specifier), specifier, F.concat(F.lit("include/"), specifier), F.concat(F.lit("src/"), specifier))


def import_candidates(family: Column, importer: Column, specifier: Column, imported_name: Column) -> Column:
    """Candidate paths by the importer's language family."""
    return (
        F.when(family == "python", python_candidates(importer, specifier))
        .when(family == "rust", rust_candidates(importer, F.when(imported_name.isNull(), specifier).otherwise(F.concat(specifier, F.lit("::"), imported_name))))
        .when(family.isin("javascript", "typescript", "script", "vue", "svelte"), script_candidates(importer, specifier))
        .when(family.isin("java", "kotlin", "jvm"), jvm_candidates(specifier, imported_name))
        .when(family.isin("c", "cpp"), include_candidates(importer, specifier))
        .otherwise(F.array().cast("array<string>"))
    )


def changed_ranges(old: DataFrame, new: DataFrame, content: str = "content") -> DataFrame:
    """path, line, change of lines that differ between two snapshots. Files meet by their paths, and only those whose content differs
    are compared: the longest common runs of lines stay, what is between them is changed as far as both sides have lines there,
    else added or deleted. Lines are those of the new file, deleted ones those of the old."""
    a, b = (df.select("path", F.col(content).alias(c), F.lit(True).alias(f"has_{c}")) for df, c in ((old, "a"), (new, "b")))
    both = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")) | F.col("has_a").isNull() | F.col("has_b").isNull()).select("path", "a", "b")

    def run(batches):
        for rows in batches:
            out = [(path, line, change) for path, x, y in zip(rows["path"], rows["a"], rows["b"], strict=True) for line, change in line_changes(x, y)]
            yield pd.DataFrame({c: [o[i] for o in out] for i, c in enumerate(("path", "line", "change"))})

    return both.mapInPandas(run, T.StructType([both.schema["path"], T.StructField("line", T.LongType()), T.StructField("change", T.StringType())]))


def line_changes(old: str | None, new: str | None) -> Iterator[tuple[int, str]]:
    """Line (from 1) and change of what differs."""
    x, y = ([] if t is None else t.split("\n") for t in (old, new))
    for tag, a, b, c, d in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        both = min(b - a, d - c)
        yield from ((c + i + 1, "changed") for i in range(both))
        yield from ((i + 1, "added") for i in range(c + both, d))
        yield from ((i + 1, "deleted") for i in range(a + both, b))
