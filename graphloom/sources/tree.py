"""Source trees read by Spark's binary file source: listing, filters, decoding and bundles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import extension, glob_regex, has_content, language_of, walkable

MOST_BYTES, NOTEBOOK_BYTES = 1_048_576, 10_485_760


def ignore_patterns(text: str) -> list[tuple[bool, str]]:
    """Rules of an ignore file as (keeps, pattern) in order; a later rule wins."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        glob = line[keeps:].rstrip("/")
        pattern = glob_regex(glob.lstrip("/"), crosses=False)[1:-1]
        head = "^" if "/" in glob else "^(?:.*/)?"
        out.append((keeps, f"{head}{pattern}(?:/.*)?$"))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    verdict = F.lit(False)
    for keeps, pattern in rules:
        verdict = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(verdict)
    return verdict


def read_tree(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """path (below root), language, size, mtime, content of each file that a walk reaches. Spark lists and reads the files in
    its tasks; the ignore rules are compiled once on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return rows.where(walkable(F.col("path")) & ~ignored(F.col("path"), ignore_patterns(ignore))).withColumn("language", language_of(F.col("path")))


def source_files(tree: DataFrame, languages: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files to parse, tagged: `in_scope` is false for those that a language filter leaves out (they are not removed)."""
    rows = tree.where(F.col("language").isNotNull() & ~F.col("path").contains(".min.") & (F.col("size") <= most_bytes))
    scope = F.col("language").isin(languages) if languages else F.lit(True)
    return rows.withColumn("in_scope", scope).withColumn("text", F.decode("content", "UTF-8")).withColumn("content_hash", F.sha2("content", 256))


def bundle_files(tree: DataFrame, most_kb: int) -> DataFrame:
    """Every path, with content where a context bundle shows it; notebooks are cut to their cells first."""
    shown = has_content(F.col("path")) & (F.col("size") <= most_kb * 1024)
    notebook = F.lower(extension(F.col("path"))) == "ipynb"
    text = F.decode("content", "UTF-8")
    return tree.select("path", F.when(notebook & (F.col("size") <= NOTEBOOK_BYTES), notebook_text(text)).when(shown & ~notebook, text).alias("text"))


def notebook_text(json: Column) -> Column:
    """A notebook as Markdown: text cells as they are, code cells fenced; outputs and metadata go."""
    book = F.from_json(json, "cells array<struct<cell_type:string,source:string>>, metadata struct<language_info:struct<name:string>>")
    language = F.coalesce(book["metadata"]["language_info"]["name"], F.lit("python"))

    def cell(c: Column) -> Column:
        parts = F.from_json(c["source"], "array<string>")
        body = F.coalesce(F.array_join(parts, ""), c["source"])
        return F.when(c["cell_type"] == "code", F.concat(F.lit("```"), language, F.lit("\n"), body, F.lit("\n```"))).otherwise(body)

    return F.array_join(F.transform(book["cells"], cell), "\n\n")


def related(tree: DataFrame, paths: DataFrame) -> DataFrame:
    return tree.join(paths.select("path").distinct(), "path", "left_semi").orderBy("path")
