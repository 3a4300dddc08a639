"""Hybrid candidates, facts of hits, changed identities, communities of symbols and what is to be indexed again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import facts, ingest
from graphloom.operators.storage import shared_dir
from graphloom.queries.base import Registry, table
from graphloom.queries.corpus import _STATUS, _snapshots
from graphloom.queries.views import SYMBOLS_SQL, files, symbols
from graphloom.streaming import sync

registry = Registry()
add = registry.add
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@add(f"WITH s AS ({SYMBOLS_SQL}) SELECT id, name, 1 AS tier FROM s WHERE lower(name) IN ('small ring', 'large gear') AND is_exported")
def hybrid_candidates(spark, sf_dir):
    """No name holds the whole question, so the identifiers that it quotes decide."""
    s = symbols(spark, sf_dir).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))
    found = facts.hybrid_candidates(s, "where is `small_ring` or `large_gear` made", exported=True)
    return found.select("id", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"), "tier")


@add("""WITH s AS (SELECT p_partkey AS symbol_id, p_brand AS path, p_name AS name, p_size * 10 AS a, p_size * 10 + 15 AS b FROM part), h AS (SELECT 'k' || symbol_id AS key, path, name, a + 5 AS a, b + 5 AS b, symbol_id % 2 = 0 AS known, symbol_id FROM s),
o AS (SELECT h.key, count(*) AS n, min(s.symbol_id) AS found FROM h JOIN s ON h.path = s.path AND h.name = s.name AND s.a < h.b AND s.b > h.a WHERE NOT known GROUP BY h.key)
SELECT key, CASE WHEN known THEN symbol_id WHEN n = 1 THEN found END AS symbol_id FROM h LEFT JOIN o USING (key)""")
def facts_of_hits(spark, sf_dir):
    p, start = table(spark, sf_dir, "part"), F.col("p_size") * 10
    s = p.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "k").otherwise("x"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), start.alias("start"), (start + 15).alias("end"), F.col("p_partkey").alias("symbol_id"))
    hits = p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), (start + 5).alias("start"), (start + 20).alias("end"))
    return facts.with_facts(hits, s).select("key", "symbol_id")


@add("""WITH i AS (SELECT p_brand AS path, p_name AS name, list_sort(list(p_type) FILTER (p_partkey % 5 > 0)) AS a, list_sort(list(CASE WHEN p_partkey % 11 = 0 THEN p_type || '!' ELSE p_type END) FILTER (p_partkey % 7 > 0)) AS b FROM part GROUP BY ALL)
SELECT path, name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM i WHERE a IS DISTINCT FROM b""")
def identity_changes(spark, sf_dir):
    """Parts of two revisions: some are missing in either, some have another type."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("hash"))
    after = p.where("p_partkey % 7 > 0").withColumn("hash", F.when(F.col("p_partkey") % 11 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    return facts.identity_changes(p.where("p_partkey % 5 > 0"), after, ["path", "name"])


@add("SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS community FROM part")
def inherited_communities(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.col("p_size").cast("string")).alias("path"))
    sizes = nodes.select("path").distinct()
    n = F.split("path", "/")[1].cast("int") % 3
    return facts.inherited_communities(nodes, sizes.where(n > 0).select(F.concat(F.lit("file:"), "path").alias("id"), n.alias("community"))).select("id", "community")


@add("SELECT doc_id AS file_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0")
def index_backfill(spark, sf_dir):
    """Some files have no mark, some one of other content and some one of an older version."""
    f = ingest.with_hash(files(spark, sf_dir)).select("file_id", "content_hash")
    old = F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("2:"), F.sha2(F.lit("old").cast("binary"), 256))).when(F.col("file_id") % 5 == 0, F.concat(F.lit("1:"), "content_hash")).otherwise(F.concat(F.lit("2:"), "content_hash"))
    return facts.to_index(f, f.where("file_id % 3 > 0").select("file_id", old.alias("marker")), "2").select("file_id")


@add(_STATUS + " SELECT 41 + CAST(count_if(status IN ('added', 'changed', 'removed')) > 0 AS BIGINT) AS generation, count_if(status IN ('added', 'changed', 'removed')) > 0 AS invalid FROM s")
def generations(spark, sf_dir):
    meta = spark.sql("SELECT * FROM VALUES ('generation', '41'), ('analyzer', '3') AS t(key, value)")
    return facts.generation(meta, _snapshots(spark, sf_dir))


@add("SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 5 > 0")
def sync_store(spark, sf_dir):
    """All documents come to the store of the sync stream in one batch; in a second one some have changed and some are gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    row = lambda df, content, deleted, at: df.select("path", content.alias("content"), deleted.alias("deleted"), F.lit(at).cast("timestamp").alias("at"))
    gone = F.col("doc_id") % 5 == 0
    store = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    sync.apply_batch(row(d, F.col("content"), F.lit(False), "2024-01-01"), 0, store)
    later = d.where((F.col("doc_id") % 3 == 0) | gone)
    sync.apply_batch(row(later, F.when(~gone, F.concat("content", F.lit("!"))), gone, "2024-01-02"), 1, store)
    return sync.current(spark, store).select("path", "content_hash")
