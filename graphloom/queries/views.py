"""How the operators' logical tables are read from the star schema, in Spark and in DuckDB.

files: a document is a file; its source and language are directories, and its extension follows from its language.
symbols: a part is a symbol; its brand is the owner and its type the kind.
edges: an order calls the parts of its lines; the discount gives the confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.queries.base import table

EXTENSIONS = {"en": "py", "fr": "rs", "de": "min.js", "es": "toml"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items())

FILES_SQL = f"SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.' || CASE lang {_CASES} ELSE 'txt' END AS path, text AS content, length(text) AS size FROM documents"
SYMBOLS_SQL = "SELECT p_partkey AS id, p_name AS name, p_brand AS owner, p_type AS kind, p_size AS line, p_brand || '/' || p_type AS path, p_size % 2 = 0 AS is_exported, CAST(NULL AS VARCHAR) AS signature FROM part"
EDGES_SQL = """SELECT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'references' ELSE 'calls' END AS kind, round(1 - l_discount, 2) AS confidence, CAST(l_linenumber AS BIGINT) AS line FROM lineitem"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.lit("txt")
    for lang, e in EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("content"), F.length("text").cast("long").alias("size"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"), F.col("p_type").alias("kind"), F.col("p_size").alias("line"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("path"), (F.col("p_size") % 2 == 0).alias("is_exported"), F.lit(None).cast("string").alias("signature"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target"),
        F.when(F.col("l_returnflag") == "R", "references").otherwise("calls").alias("kind"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").cast("long").alias("line"),
    )
