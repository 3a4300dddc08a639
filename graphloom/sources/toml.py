"""Keys of TOML files as string literals: table-qualified names, found line by line with built-in expressions.

A header scopes the keys below it; the header of a line is the last one above it within its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLEE = "<toml-key>"


def _unquoted(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"""^(?:"[\s\S]*"|'[\s\S]*')$""") & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def _without_comment(line: Column) -> Column:
    """Up to the first # outside quotes."""
    kept = F.regexp_extract(line, r"""^((?:[^"'#]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|["'][^#]*$)*)""", 1)
    return F.trim(kept)


def toml_keys(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """key, value, callee, line: each `name = ...` with its table's name before it."""
    rows = files.select(key, F.posexplode(F.split(content, "\r?\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("line", _without_comment(F.col("raw"))).where("line <> ''")
    inner = F.coalesce(F.nullif(F.regexp_extract("line", r"^\[\[(.*)\]\]$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\[(.*)\]$", 1), F.lit("")))
    table = F.array_join(F.transform(F.split(inner, r"\."), _unquoted), ".")
    above = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_table", F.col("line").rlike(r"^\[.*\]$")).withColumn("table", F.last(F.when(F.col("is_table"), table), ignorenulls=True).over(above))
    name = _unquoted(F.regexp_extract("line", r"^([^=]*)=", 1))
    keys = rows.where(~F.col("is_table") & F.col("line").contains("=")).withColumn("name", name).where((F.col("name") != "") & ~F.col("name").rlike(r"\s"))
    value = F.when(F.coalesce("table", F.lit("")) == "", F.col("name")).otherwise(F.concat("table", F.lit("."), "name"))
    return keys.select(key, value.alias("value"), F.lit(CALLEE).alias("callee"), (F.col("pos") + 1).alias("line"))
