"""Targets, visibility, risk, snippets, subsystems, scopes and the final order."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.operators import explain, graph, resolve
from graphloom.queries.base import Registry, table
from graphloom.queries.corpus import terms_sql
from graphloom.queries.graphs import _MEMBERS, _nation_links, _regions
from graphloom.queries.views import FILES_SQL, SYMBOLS_SQL, files, symbols

registry = Registry()
add = registry.add
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE


@add(f"WITH s AS ({SYMBOLS_SQL}) SELECT id, name FROM s WHERE name = 'small ring' OR owner || '::' || name = 'small ring' OR path = 'small ring' OR path LIKE '%small ring'")
def find_targets(spark, sf_dir):
    s = symbols(spark, sf_dir).withColumns({"label": F.col("name"), "qualified": F.concat("owner", F.lit("::"), "name"), "key": F.col("id"), "id": F.col("id").cast("string")})
    return explain.find_targets(s, "small ring").select(F.col("key").alias("id"), "name")


@add("""SELECT l_orderkey, l_linenumber, count(*) AS n, bool_and(CASE (l_shipdate::DATE::VARCHAR)[10:10] WHEN '1' THEN l_suppkey % 3 = 0 AND l_suppkey % 5 = 0 WHEN '3' THEN l_partkey % 2 = 0 ELSE true END) AS visible FROM lineitem GROUP BY ALL""")
def visibility(spark, sf_dir):
    """Whether a line, as a Java reference from one of two files, owners and packages, may see a symbol of the kind that its day gives."""
    x = table(spark, sf_dir, "lineitem")
    d = F.substring(F.date_format("l_shipdate", "yyyy-MM-dd"), 10, 1)
    kind = F.when(d == "1", "private").when(d == "2", "protected").when(d == "3", "package").otherwise("public")
    one = lambda hit, name: F.when(hit, F.lit(name)).otherwise("other")
    pair = {"s_path": F.lit("f"), "s_owner": F.lit("O"), "s_package": F.lit("p"), "s_visibility": kind, "language": F.lit("java"), "receiver_bases": F.array().cast("array<string>")}
    pair |= {"file": one(F.col("l_suppkey") % 3 == 0, "f"), "owner": one(F.col("l_suppkey") % 5 == 0, "O"), "package": one(F.col("l_partkey") % 2 == 0, "p")}
    return x.withColumns(pair).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.bool_and(resolve.visible()).alias("visible"))


@add("""SELECT event_id, event_type = 'view' OR coalesce(v <= 0.7, false) OR coalesce(CASE WHEN event_id % 3 <> 0 THEN user_id % 4 <> event_id % 4 ELSE split_part(event_type || '/x', '/', 1) <> 'click' END, false) AS risky FROM (SELECT *, value - floor(value) AS v FROM events)""")
def risk(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    known = F.col("event_id") % 3 != 0
    got = explain.risky(F.col("event_type") == "view", F.col("value") - F.floor("value"), F.when(known, F.col("user_id") % 4), F.when(known, F.col("event_id") % 4), F.concat("event_type", F.lit("/x")), F.lit("click/y"))
    return e.select("event_id", got.alias("risky"))


@add(f"""WITH f AS ({FILES_SQL}) SELECT path, 1 + file_id % 3 AS line, sha256(nullif(regexp_replace(string_split(content, chr(10))[1 + file_id % 3], '^[\\t-\\r\\p{{Z}}]+|[\\t-\\r\\p{{Z}}]+$', '', 'g'), '')) AS snippet FROM f""")
def edge_snippets(spark, sf_dir):
    f = files(spark, sf_dir)
    e = f.select("path", (1 + F.col("file_id") % 3).alias("line"))
    return explain.snippets(e, f).select("path", "line", F.sha2(F.col("snippet").cast("binary"), 256).alias("snippet"))


@add(_MEMBERS + ", u AS (SELECT ca AS community, weight AS internal, 0 AS external FROM c WHERE ca = cb UNION ALL SELECT ca, 0, weight FROM c WHERE ca <> cb UNION ALL SELECT cb, 0, weight FROM c WHERE ca <> cb), t AS (SELECT community, sum(internal)::BIGINT AS internal, sum(external)::BIGINT AS external FROM u GROUP BY community), z AS (SELECT community, count(*) AS size FROM m GROUP BY community) SELECT community, size, internal, external, round(internal::DOUBLE / (internal + external), 2) AS cohesion FROM t JOIN z USING (community)")
def subsystems(spark, sf_dir):
    m = _regions(spark, sf_dir)
    counts = graph.community_links(_nation_links(spark, sf_dir), m)[0].join(m.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "community")
    return explain.subsystems(counts)


@add("""SELECT p_partkey AS "key", p_name = 'small ring' AS exact, p_name LIKE 'small%' AS lexical, p_retailprice AS relevance FROM part ORDER BY exact DESC, lexical DESC, relevance DESC NULLS LAST, p_brand, p_size, p_partkey LIMIT 25""")
def final_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hits = p.select(F.col("p_partkey").alias("key"), (F.col("p_name") == "small ring").alias("exact"), F.col("p_name").startswith("small").alias("lexical"), F.col("p_retailprice").alias("relevance"), F.col("p_brand").alias("path"), F.col("p_size").alias("start"))
    return explain.final_order(hits, 25).select("key", "exact", "lexical", "relevance")


@add(f"""WITH t AS (SELECT item_id, unnest({terms_sql('text')}) AS operation, unnest(range(1, len({terms_sql('text')}) + 1)) AS position FROM benchmark), f AS (SELECT operation, count(DISTINCT item_id) AS files FROM t GROUP BY 1), o AS (SELECT item_id, operation, min(position) AS position FROM t GROUP BY ALL),
r AS (SELECT o.*, row_number() OVER (PARTITION BY item_id ORDER BY files, position, operation) AS k FROM o JOIN f USING (operation)) SELECT item_id AS "key", operation, position FROM r WHERE k <= 16""")
def rarest_operations(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("item_id").alias("file"), F.posexplode(terms(F.col("text"))).alias("p", "operation"))
    return explain.rarest_operations(b.withColumn("position", (F.col("p") + 1).cast("long")))


@add("SELECT CASE WHEN n <= 64 THEN 64 WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 384 THEN 384 ELSE 512 END AS bucket, count(*) AS inputs FROM (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents) GROUP BY 1")
def length_buckets(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return table(spark, sf_dir, "documents").groupBy(explain.length_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("inputs"))


@add("""WITH f AS (SELECT DISTINCT 'r' || n_regionkey AS owner, 'n' || n_nationkey AS name, 'n' || n_nationkey AS type FROM nation UNION SELECT DISTINCT 'n' || s_nationkey, 's' || s_suppkey, 'leaf' || s_suppkey FROM supplier) SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'leaf' || s_suppkey END AS type FROM supplier""")
def field_chains(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    fields = n.select(key("r", "n_regionkey").alias("owner"), key("n", "n_nationkey").alias("name"), key("n", "n_nationkey").alias("type")).unionByName(s.select(key("n", "s_nationkey").alias("owner"), key("s", "s_suppkey").alias("name"), key("leaf", "s_suppkey").alias("type")))
    starts = s.join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    hops = F.array(key("n", "s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, key("s", "s_suppkey")).otherwise(F.lit("none")))
    return explain.field_chain(starts.select(F.col("s_suppkey").alias("id"), key("r", "n_regionkey").alias("type"), hops.alias("hops")), fields)


_SCOPES = """s AS (SELECT l_orderkey * 100 + l_linenumber * 10 + 1 AS scope_id, l_orderkey AS file_id, 0 AS a, 400 AS b FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL UNION ALL SELECT l_orderkey * 100 + l_linenumber * 10 + 2, l_orderkey, l_linenumber * 20, l_linenumber * 20 + 15 FROM lineitem GROUP BY ALL),
d AS (SELECT scope_id * 10 + k AS binding_id, scope_id, 'v' || k AS name, CASE k WHEN 0 THEN 'param' ELSE 'local' END AS kind, a AS since FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE (scope_id + k) % 3 > 0)"""


@add(f"""WITH {_SCOPES}, u AS (SELECT o_orderkey AS use_id, o_orderkey AS file_id, 'v' || (o_custkey % 3) AS name, 5 + o_custkey % 120 AS position FROM orders), h AS (SELECT use_id, binding_id, kind, b - a AS width FROM u JOIN s USING (file_id) JOIN d USING (scope_id, name) WHERE a <= position AND position < b AND since <= position),
f AS (SELECT *, min(width) OVER (PARTITION BY use_id) AS least FROM h) SELECT use_id, min(binding_id) AS binding_id, min(kind) AS kind FROM f WHERE width = least GROUP BY use_id HAVING count(*) = 1""")
def scope_bindings(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    base = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    outer = x.where("l_linenumber = 1").select((base + 1).alias("scope_id"), F.col("l_orderkey").alias("file_id"), F.lit(0).alias("start"), F.lit(400).alias("end"))
    inner = x.select((base + 2).alias("scope_id"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 20).alias("start"), (F.col("l_linenumber") * 20 + 15).alias("end"))
    s = outer.unionByName(inner)
    d = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((F.col("scope_id") + F.col("k")) % 3 > 0)
    d = d.select((F.col("scope_id") * 10 + F.col("k")).alias("binding_id"), "scope_id", F.concat(F.lit("v"), F.col("k").cast("string")).alias("name"), F.when(F.col("k") == 0, "param").otherwise("local").alias("kind"), F.col("start").alias("at"))
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("use_id"), F.col("o_orderkey").alias("file_id"), F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")).alias("name"), (5 + F.col("o_custkey") % 120).alias("position"))
    return explain.scope_bindings(u, s, d)


@add("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 = 0 OR doc_id % 7 = 0")
def snapshot_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    stored = d.where("path % 4 <> 0").withColumn("content", F.when(F.col("path") % 7 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    got = explain.repaired_snapshots(stored, d.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")))
    return got.select(F.col("path").alias("doc_id"), "content_hash")


@add("SELECT regexp_extract(p_brand || '/' || p_type, '^(.*)/[^/]*$', 1) AS directory, p_type AS owner, list(p_name ORDER BY p_size, p_name) AS members FROM part GROUP BY ALL")
def explain_siblings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return explain.siblings(p.select(F.concat("p_brand", F.lit("/"), "p_type").alias("path"), F.col("p_type").alias("owner"), F.col("p_size").alias("line"), F.col("p_name").alias("name")))


@add(f"WITH f AS ({FILES_SQL}) SELECT count(*) AS files, count(DISTINCT split_part(path, '/', 2)) AS languages, sum(size)::BIGINT AS size, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM lineitem WHERE 1 - l_discount < 0.5) AS doubtful, (SELECT count(DISTINCT n_regionkey) FROM nation) AS communities FROM f")
def report_totals(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("language", F.split("path", "/")[1])
    return explain.report(f, table(spark, sf_dir, "lineitem").select((1 - F.col("l_discount")).alias("confidence")), _regions(spark, sf_dir))
