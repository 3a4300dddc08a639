"""Graph assembly, ranking and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, traverse
from graphloom.queries.base import Registry, table
from graphloom.queries.views import EDGES_SQL, edges, symbols

registry = Registry()
add = registry.add
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE

_E = f"WITH e AS ({EDGES_SQL})"
_AGG = "SELECT source, target, kind, max(confidence) AS confidence FROM e GROUP BY source, target, kind"


@add(_E + ", m AS (" + _AGG + ") SELECT m.source, m.target, m.kind, m.confidence, min(e.line) AS line, (SELECT count(*) FROM e x WHERE x.source = m.source AND x.target = m.target AND x.kind = m.kind) AS parallel FROM m JOIN e ON e.source = m.source AND e.target = m.target AND e.kind = m.kind AND e.confidence = m.confidence GROUP BY ALL")
def edge_aggregate(spark, sf_dir):
    return graph.aggregated(edges(spark, sf_dir))


@add(_E + " SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e WHERE kind <> 'contains' UNION ALL SELECT target FROM e WHERE kind <> 'contains') GROUP BY id")
def degree(spark, sf_dir):
    return graph.degree(edges(spark, sf_dir))


_PARTS = "SELECT 'p:' || p_partkey AS id, p_name AS label, CASE WHEN p_size % 4 = 0 THEN 'method' ELSE 'function' END AS kind, p_brand || '/' || p_type || '.rs' AS path, p_size % 2 = 0 AS exported FROM part"


def _part_nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 4 == 0, "method").otherwise("function").alias("kind"), F.concat("p_brand", F.lit("/"), "p_type", F.lit(".rs")).alias("path"), (F.col("p_size") % 2 == 0).alias("exported"))


@add(_E + f", n AS ({_PARTS}), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT id, label, kind, path, degree FROM n JOIN d USING (id) WHERE degree >= 3 ORDER BY degree DESC, label, id LIMIT 10")
def hubs(spark, sf_dir):
    return graph.hubs(_part_nodes(spark, sf_dir), edges(spark, sf_dir))


@add("""SELECT 'file:' || p_brand || '/' || p_type AS source, 'sym:' || p_brand || '/' || p_type || '#' || p_name || '@' || p_size || ':' || (p_size + 10) || ':function' AS target, count(*) AS n FROM part GROUP BY ALL""")
def node_identities(spark, sf_dir):
    s = symbols(spark, sf_dir)
    ident = graph.symbol_id(F.col("path"), F.col("name"), F.col("line"), F.col("line") + 10, F.lit("function"))
    return s.groupBy(graph.file_id(F.col("path")).alias("source"), ident.alias("target")).agg(F.count(F.lit(1)).alias("n"))


@add("""WITH n AS (SELECT n_nationkey, n_regionkey FROM nation) SELECT CASE WHEN n_regionkey IS NOT NULL THEN 'n:' || n_nationkey ELSE 'w' END AS source, 's:' || s_suppkey AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM supplier LEFT JOIN n ON s_nationkey = n_nationkey AND n_regionkey < 3
WHERE n_regionkey IS NOT NULL UNION ALL SELECT 'w', 's:' || s_suppkey, 'contains', 1.0::DOUBLE FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def contains_edges(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    child = table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey").alias("id"), key("n:", "s_nationkey").alias("parent"), F.lit("w").alias("file"))
    parents = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(key("n:", "n_nationkey").alias("id"))
    return graph.contains_edges(child, parents)


@add("""SELECT 'file:' || url AS source, 'ext:' || split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS target FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '://([^/?#]*)', 1) FROM pages WHERE page_id % 3 = 0)""")
def external_edges(spark, sf_dir):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))
    ours = p.where("page_id % 3 = 0").select("host").distinct()
    return p.join(ours, "host", "left_anti").select(graph.file_id(F.col("url")).alias("source"), graph.external_id(F.substring_index("host", ".", 1)).alias("target"))


@add("SELECT 'p:' || p_partkey AS id, p_brand || '/' || p_type || '.rs' AS file FROM part")
def owner_files(spark, sf_dir):
    return _owners(spark, sf_dir)


def _owners(spark, sf_dir):
    return _part_nodes(spark, sf_dir).select("id", F.col("path").alias("file"))


_COLL = _E + ", f AS (SELECT 'p:' || p_partkey AS id, p_brand || '/' || p_type || '.rs' AS file FROM part), m AS (SELECT source, coalesce(f.file, target) AS target, kind, confidence, line FROM e LEFT JOIN f ON e.target = f.id)"


@add(_COLL + ", r AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY confidence DESC, line) AS k FROM m WHERE source <> target) SELECT source, target, kind, confidence, line FROM r WHERE k = 1")
def collapse_files(spark, sf_dir):
    return graph.collapsed(edges(spark, sf_dir), _owners(spark, sf_dir))


@add(_E + f", n AS ({_PARTS} UNION ALL SELECT 'file:a', 'a', 'file', 'a', false), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id), r AS (SELECT n.*, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, n.id DESC) AS k FROM n LEFT JOIN d USING (id) WHERE kind <> 'file'), kept AS (SELECT id FROM r WHERE k <= 99 UNION ALL SELECT id FROM n WHERE kind = 'file'), gone AS (SELECT id FROM r WHERE k > 99) SELECT id, (SELECT count(*) FROM e WHERE target = id AND source NOT IN (SELECT id FROM gone)) AS edges FROM kept")
def node_cap(spark, sf_dir):
    one = spark.range(1).select(F.lit("file:a").alias("id"), F.lit("a").alias("label"), F.lit("file").alias("kind"), F.lit("a").alias("path"), F.lit(False).alias("exported"))
    nodes, links = graph.capped(_part_nodes(spark, sf_dir).unionByName(one), edges(spark, sf_dir), 100)
    held = links.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(held, "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges"))


@add("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p), x AS (SELECT path, parts, unnest(range(2, len(parts) + 1)) AS n FROM s)
SELECT DISTINCT 'dir:' || array_to_string(parts[1:n - 1], '/') AS source, CASE WHEN n = len(parts) THEN 'file:' || path ELSE 'dir:' || array_to_string(parts[1:n], '/') END AS target FROM x""")
def dir_rollup(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/$", "")
    return graph.rolled_up(table(spark, sf_dir, "pages").select(path.alias("path")))


_LINKS = """WITH x AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey),
k AS (SELECT 'n:' || least(a, b) AS l, 'n:' || greatest(a, b) AS h FROM x WHERE a <> b), links AS (SELECT least(l, h) AS low, greatest(l, h) AS high, count(*) AS weight FROM k GROUP BY ALL)"""


def _nation_links(spark, sf_dir):
    """Orders as calls: a customer calls the suppliers of its lines, and both lie in their nation's file."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    calls = x.select(key("c:", "o_custkey").alias("source"), key("s:", "l_suppkey").alias("target"), F.lit("calls").alias("kind"))
    owner = table(spark, sf_dir, "customer").select(key("c:", "c_custkey").alias("id"), key("n:", "c_nationkey").alias("file")).unionByName(table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey").alias("id"), key("n:", "s_nationkey").alias("file")))
    return graph.file_links(calls, owner)


@add(_LINKS + " SELECT * FROM links")
def file_links(spark, sf_dir):
    return _nation_links(spark, sf_dir)


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("community"))


_MEMBERS = _LINKS + ", m AS (SELECT 'n:' || n_nationkey AS id, n_regionkey AS community FROM nation), c AS (SELECT low, high, weight, a.community AS ca, b.community AS cb FROM links JOIN m a ON low = a.id JOIN m b ON high = b.id)"


@add(_MEMBERS + ", u AS (SELECT ca AS community, weight AS internal, 0 AS external FROM c WHERE ca = cb UNION ALL SELECT ca, 0, weight FROM c WHERE ca <> cb UNION ALL SELECT cb, 0, weight FROM c WHERE ca <> cb) SELECT community, sum(internal)::BIGINT AS internal, sum(external)::BIGINT AS external FROM u GROUP BY community")
def community_counts(spark, sf_dir):
    return graph.community_links(_nation_links(spark, sf_dir), _regions(spark, sf_dir))[0]


@add(_MEMBERS + ", u AS (SELECT low AS id, cb AS other, weight FROM c WHERE ca <> cb UNION ALL SELECT high, ca, weight FROM c WHERE ca <> cb) SELECT id, count(DISTINCT other) AS communities, sum(weight)::BIGINT AS links FROM u GROUP BY id ORDER BY communities DESC, links DESC, id LIMIT 5")
def report_bridges(spark, sf_dir):
    return graph.bridges(_nation_links(spark, sf_dir), _regions(spark, sf_dir))


_REFS = "SELECT event_id AS ref_id, event_type = 'view' AS local_only, event_type = 'click' AS is_external, CASE WHEN event_type IN ('view', 'click') OR user_id % 7 = 0 THEN NULL ELSE round(value - floor(value), 2) END AS confidence, event_id % 3 = 0 AS ambiguous FROM events"


@add(f"WITH r AS ({_REFS}) SELECT count_if(NOT local_only) AS eligible, count_if(NOT local_only AND confidence IS NOT NULL) AS resolved, count_if(NOT local_only AND confidence IS NOT NULL AND ambiguous) AS ambiguous, count_if(NOT local_only AND confidence IS NULL AND NOT is_external) AS unresolved, count_if(local_only) AS local_only, count_if(NOT local_only AND is_external) AS external, count_if(NOT local_only AND confidence < 0.3) AS below_min_confidence FROM r")
def resolution_summary(spark, sf_dir):
    kind = F.col("event_type")
    frac = F.round(F.col("value") - F.floor("value"), 2)
    r = table(spark, sf_dir, "events").select((kind == "view").alias("local_only"), (kind == "click").alias("is_external"), F.when(~kind.isin("view", "click") & (F.col("user_id") % 7 != 0), frac).alias("confidence"), (F.col("event_id") % 3 == 0).alias("ambiguous"))
    return graph.resolution_summary(r, 0.3)


@add(_E + " SELECT source AS node, target AS neighbour, 'out' AS direction FROM e WHERE kind = 'references' UNION ALL SELECT target, source, 'in' FROM e WHERE kind = 'references'")
def adjacency(spark, sf_dir):
    return graph.adjacency(edges(spark, sf_dir), ["references"])


@add("""SELECT split_part(path, '/', 1) AS directory, path, "group", count(*) AS n, list_sort(list(name)) AS names FROM (SELECT p_brand || '/' || p_type AS path, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'types' WHEN p_size % 3 = 1 THEN 'functions' ELSE 'other' END AS "group" FROM part WHERE p_size % 2 = 0) GROUP BY ALL""")
def digest_outline(spark, sf_dir):
    kind = F.when(F.col("line") % 3 == 0, "struct").when(F.col("line") % 3 == 1, "function").otherwise("constant")
    return graph.outline(symbols(spark, sf_dir).withColumn("kind", kind))


# Walks.

_WALK = "WITH RECURSIVE links AS (SELECT DISTINCT 'c:' || o_custkey AS a, 'n:' || c_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"


def _hierarchy(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(key("c:", "o_custkey").alias("source"), key("n:", "c_nationkey").alias("target")).distinct()
    n = table(spark, sf_dir, "nation").select(key("n:", "n_nationkey").alias("source"), key("r:", "n_regionkey").alias("target"))
    return c.unionByName(n).withColumn("kind", F.lit("contains"))


@add(_WALK + ", w AS (SELECT 'r:1' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM w JOIN both_ways ON node = a WHERE distance < 2) SELECT node, min(distance) AS distance FROM w GROUP BY node")
def focus_khop(spark, sf_dir):
    return traverse.reach(_hierarchy(spark, sf_dir), spark.sql("SELECT 'r:1' AS node"), 2)


_TREE = """WITH RECURSIVE e AS (SELECT DISTINCT 'n:' || c.c_nationkey AS source, 'n:' || s.s_nationkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey),
w AS (SELECT target AS node, ['n:1', target] AS path, 1 AS level FROM e WHERE source = 'n:1' AND target <> 'n:1' UNION ALL SELECT e.target, list_append(w.path, e.target), level + 1 FROM w JOIN e ON w.node = e.source WHERE level < 3 AND NOT list_contains(w.path, e.target))"""


def _calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey")
    x = x.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return x.select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("target"), F.lit("calls").alias("kind")).distinct()


@add(_TREE + " SELECT node, path, level FROM w")
def impact_tree(spark, sf_dir):
    return traverse.simple_paths(_calls(spark, sf_dir), spark.sql("SELECT 'n:1' AS node"), 3).select("node", "path", "level")


@add(_TREE + " SELECT 'n:1' AS seed, count_if(level = 1) AS direct, count(DISTINCT node) AS total, count(DISTINCT r) AS files, max(level) AS depth FROM w LEFT JOIN (SELECT 'n:' || n_nationkey AS id, n_regionkey AS r FROM nation) ON id = node HAVING count(*) > 0")
def impact_counts(spark, sf_dir):
    paths = traverse.simple_paths(_calls(spark, sf_dir), spark.sql("SELECT 'n:1' AS node"), 3)
    nodes = _regions(spark, sf_dir).select("id", F.col("community").alias("path"))
    return traverse.impact_counts(paths, nodes)


@add(_WALK + ", w AS (SELECT 'r:' || r_regionkey AS start, 'r:' || r_regionkey AS node, 0 AS d FROM region UNION SELECT start, b, d + 1 FROM w JOIN both_ways ON node = a WHERE d < 2) SELECT start, 'n:7' AS goal, min(d) FILTER (node = 'n:7')::INT AS length FROM w GROUP BY start")
def shortest_path(spark, sf_dir):
    pairs = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("start"), F.lit("n:7").alias("goal"))
    return traverse.shortest(_hierarchy(spark, sf_dir), pairs, most=2, direction="any").select("start", "goal", "length")


_TEN = "SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 1"


@add(f"WITH RECURSIVE e AS ({_TEN}), w AS (SELECT source, target FROM e UNION SELECT w.source, e.target FROM w JOIN e ON w.target = e.source) SELECT source, target FROM w")
def include_closure(spark, sf_dir):
    e = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target"))
    return traverse.closure(e)


@add("""WITH RECURSIVE s AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey > 3 THEN p_partkey // 4 END AS parent FROM part), w AS (SELECT id, parent AS at, CAST([] AS VARCHAR[]) AS owners FROM s UNION ALL SELECT w.id, s.parent, list_prepend(s.name, w.owners) FROM w JOIN s ON w.at = s.id)
SELECT id, owners FROM (SELECT id, owners, row_number() OVER (PARTITION BY id ORDER BY len(owners) DESC) AS k FROM w) WHERE k = 1""")
def owner_chain(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") > 3, F.floor(F.col("p_partkey") / 4)).alias("parent"))
    return traverse.owner_chains(s)
