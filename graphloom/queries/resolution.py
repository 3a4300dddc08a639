"""Reference resolution, interval joins, diffs, verification and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import intervals, resolve, retrieval, search, traverse
from graphloom.queries.base import Registry, table
from graphloom.queries.views import FILES_SQL, files

registry = Registry()
add = registry.add
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE

_SPANS = 'SELECT l_orderkey AS file_id, l_orderkey * 10 + l_linenumber AS span_id, l_linenumber * 10 AS "start", l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem'


def _spans(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("long")
    return x.select(F.col("l_orderkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


@add(f"""WITH s AS ({_SPANS}), p AS (SELECT o_orderkey AS point_id, o_orderkey AS file_id, 15 + o_custkey % 50 AS position FROM orders), h AS (SELECT point_id, span_id, row_number() OVER (PARTITION BY point_id ORDER BY "end" - "start", "start", span_id) AS k FROM p JOIN s USING (file_id) WHERE "start" <= position AND position < "end")
SELECT p.point_id, h.span_id FROM p LEFT JOIN (SELECT * FROM h WHERE k = 1) h USING (point_id)""")
def innermost_interval(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("file_id"), (15 + F.col("o_custkey") % 50).alias("position"))
    return intervals.innermost(p, _spans(spark, sf_dir), bucket=16)


@add(f"""WITH s AS ({_SPANS}), r AS (SELECT o_orderkey AS range_id, o_orderkey AS file_id, 20 + o_custkey % 30 AS lo, 22 + o_custkey % 30 AS hi FROM orders)
SELECT range_id, span_id, CAST(row_number() OVER (PARTITION BY range_id ORDER BY "end" - "start", "start", span_id) AS INT) AS place FROM r JOIN s USING (file_id) WHERE lo <= "end" AND hi >= "start\"""")
def overlap_join(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("range_id"), F.col("o_orderkey").alias("file_id"), (20 + F.col("o_custkey") % 30).alias("lo"), (22 + F.col("o_custkey") % 30).alias("hi"))
    return intervals.overlapping(r, _spans(spark, sf_dir))


@add("""WITH f AS (SELECT DISTINCT p_brand || '/' || p_type || '.py' AS path FROM part WHERE p_size < 6), i AS (SELECT p_partkey AS import_id, p_brand AS b, p_type AS t FROM part), c AS (SELECT import_id, 0 AS pos, b || '/' || t || '.py' AS path FROM i UNION ALL SELECT import_id, 1, b || '/' || t || '/__init__.py' FROM i)
SELECT import_id, arg_min(c.path, pos) AS path FROM c JOIN f USING (path) GROUP BY import_id""")
def import_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_size < 6").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit(".py")).alias("path"))
    i = p.select(F.col("p_partkey").alias("import_id"), F.concat("p_brand", F.lit("/main.py")).alias("importer"), F.concat(F.lit("."), "p_type").alias("specifier"))
    return intervals.first_existing(i, intervals.python_candidates(F.col("importer"), F.col("specifier")), known)


# A reference for each order: a part's name is used from the customer's package. Orders go round all parts (keys from 0). Some
# orders are bound to the part by scope or import, some through a module, and some files are reachable.
_RS = """x AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS n, o_custkey AS c, o_orderkey % (SELECT count(*) FROM part) AS part FROM orders),
r AS (SELECT k AS ref_id, p_name AS name, CASE WHEN n % 3 = 0 THEN 'type' ELSE 'call' END AS ref_kind, CASE WHEN n % 4 = 0 THEN 'value' WHEN n = 5 THEN 'path' ELSE 'none' END AS receiver_kind, CASE WHEN n = 5 THEN 'mod' WHEN n % 4 = 0 THEN 'it' END AS receiver,
 CASE WHEN n % 4 = 0 AND k % 2 = 0 THEN p_brand END AS receiver_type, p_brand AS owner, 'pkg' || (c % 5) AS package, 'f' || (c % 11) AS file, 'java' AS family, c % 4 AS arg_count, k % 11 = 10 AS local_only,
 CASE WHEN k % 17 = 0 THEN p_partkey END AS scope_target, CASE WHEN k % 13 = 3 THEN p_partkey END AS import_target, CASE WHEN n = 5 THEN 'f' || (k % 11) END AS namespace, 'f' || (c % 3) AS reachable FROM x JOIN part ON part = p_partkey),
s AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_name AS qualified, CASE p_size % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'class' WHEN 2 THEN 'function' ELSE 'constructor' END AS kind, p_brand AS owner, 'pkg' || (p_partkey % 5) AS package, 'f' || (p_partkey % 11) AS path, 'java' AS family, p_size % 2 = 0 AS exported, p_size % 4 AS params, p_size AS start_byte,
 CASE WHEN p_size % 7 = 0 THEN 'private' WHEN p_size % 7 = 1 THEN 'package' ELSE 'public' END AS visibility FROM part)"""


def _refs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("parts"))
    o = table(spark, sf_dir, "orders").join(F.broadcast(parts), F.lit(True)).select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % F.col("parts")).alias("p_partkey"))
    x = o.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    n, k, c, none, empty = F.col("n"), F.col("k"), F.col("c"), F.lit(None).cast("string"), F.array().cast("array<string>")
    some = lambda when, value: F.array_compact(F.array(F.when(when, value)))
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    return x.select(
        k.alias("ref_id"), F.col("p_name").alias("name"), F.when(n % 3 == 0, "type").otherwise("call").alias("ref_kind"), F.when(n % 4 == 0, "value").when(n == 5, "path").otherwise("none").alias("receiver_kind"), F.when(n == 5, "mod").when(n % 4 == 0, "it").alias("receiver"),
        F.when((n % 4 == 0) & (k % 2 == 0), F.col("p_brand")).alias("receiver_type"), empty.alias("receiver_bases"), F.col("p_brand").alias("owner"), name("pkg", c % 5).alias("package"), name("f", c % 11).alias("file"),
        F.lit("java").alias("family"), (c % 4).alias("arg_count"), (k % 11 == 10).alias("local_only"), F.when(k % 17 == 0, F.col("p_partkey")).alias("scope_target"), some(k % 13 == 3, F.col("p_partkey")).alias("import_targets"),
        some(n == 5, name("f", k % 11)).alias("namespaces"), F.array(name("f", c % 3)).alias("reachable"), none.alias("precise_status"), F.lit(None).cast("long").alias("precise_target"), F.lit(None).cast("double").alias("precise_confidence"),
    )


def _symbols(spark, sf_dir):
    p, k, v = table(spark, sf_dir, "part"), F.col("p_size") % 4, F.col("p_size") % 7
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified"), F.when(k == 0, "method").when(k == 1, "class").when(k == 2, "function").otherwise("constructor").alias("kind"), F.col("p_brand").alias("owner"),
        F.concat(F.lit("pkg"), (F.col("p_partkey") % 5).cast("string")).alias("package"), F.concat(F.lit("f"), (F.col("p_partkey") % 11).cast("string")).alias("path"), F.lit("java").alias("family"), (F.col("p_size") % 2 == 0).alias("exported"), k.alias("params"), F.col("p_size").alias("start_byte"),
        F.when(v == 0, "private").when(v == 1, "package").otherwise("public").alias("visibility"),
    )


_SCORED = f"""WITH {_RS}, c AS (SELECT r.*, s.symbol_id, s.qualified, s.path, s.start_byte, coalesce(namespace = s.path, false) AS module, coalesce(scope_target = symbol_id, false) AS scoped, coalesce(import_target = symbol_id, false) AS imported,
 CASE WHEN s.kind = 'constructor' THEN 5 ELSE 0 END + CASE WHEN scope_target = symbol_id THEN 100 ELSE 0 END + CASE WHEN import_target = symbol_id THEN 60 ELSE 0 END + CASE WHEN namespace = s.path THEN 60 ELSE 0 END + CASE WHEN reachable = s.path THEN 10 ELSE 0 END
 + CASE WHEN r.receiver_type = s.owner THEN 80 ELSE 0 END + CASE WHEN r.owner = s.owner THEN 35 ELSE 0 END + CASE WHEN r.package = s.package THEN 10 ELSE 0 END + CASE WHEN r.file = s.path THEN 15 ELSE 0 END + CASE WHEN r.arg_count = s.params THEN 3 ELSE 0 END + CASE WHEN s.exported THEN 1 ELSE 0 END AS score,
 CASE WHEN scoped THEN 'scope' WHEN module THEN 'import' WHEN r.receiver_type = s.owner THEN 'receiver' WHEN imported THEN 'import' WHEN r.owner = s.owner THEN 'owner' ELSE 'heuristic' END AS evidence
 FROM r JOIN s USING (name, family) WHERE NOT local_only AND NOT (ref_kind = 'type' AND kind <> 'class') AND NOT (kind IN ('method', 'function', 'constructor') AND arg_count <> params) AND NOT (receiver_kind = 'value' AND receiver_type IS NOT NULL AND receiver_type <> s.owner)
 AND CASE s.visibility WHEN 'private' THEN r.file = s.path AND r.owner = s.owner WHEN 'package' THEN r.package = s.package ELSE true END),
o AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, qualified, path, start_byte, symbol_id) AS place, lead(score) OVER (PARTITION BY ref_id ORDER BY score DESC, qualified, path, start_byte, symbol_id) AS next, max(score) OVER (PARTITION BY ref_id) AS top FROM c),
p AS (SELECT *, bool_or(place = 1 AND receiver_kind = 'value' AND receiver_type IS NULL AND evidence <> 'import') OVER (PARTITION BY ref_id) AS open FROM o),
b AS (SELECT ref_id, symbol_id AS target, score, evidence, open OR coalesce(score - next < 5, false) AS ambiguous FROM p WHERE place = 1),
a AS (SELECT ref_id, list(symbol_id ORDER BY place) FILTER (place <= 4) AS alternatives, count(*) AS n FROM p WHERE place > 1 AND (open OR top - score < 5) GROUP BY ref_id)
SELECT b.*, CASE WHEN ambiguous THEN 0.35 WHEN evidence = 'scope' THEN 0.95 WHEN evidence = 'import' THEN 0.9 WHEN evidence = 'receiver' THEN 0.85 WHEN evidence = 'owner' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, coalesce(alternatives, []) AS alternatives, coalesce(n - len(alternatives), 0) AS omitted FROM b LEFT JOIN a USING (ref_id)"""


@add(_SCORED)
def scored_resolution(spark, sf_dir):
    return resolve.resolved(_refs(spark, sf_dir), _symbols(spark, sf_dir))


@add("""WITH l AS (SELECT s_suppkey AS id, s_nationkey AS k, floor(s_acctbal / 1000) AS b FROM supplier), r AS (SELECT c_custkey AS m, c_nationkey AS k, floor(c_acctbal / 1000) AS b, c_mktsegment FROM customer), b AS (SELECT id, m, (c_mktsegment = 'BUILDING') AS good, max(c_mktsegment = 'BUILDING') OVER (PARTITION BY id) AS any_good FROM l JOIN r USING (k, b))
SELECT id, min(m) AS "match" FROM b WHERE good = any_good GROUP BY id HAVING count(DISTINCT m) = 1""")
def unique_match(spark, sf_dir):
    thousands = lambda c: F.floor(F.col(c) / 1000).alias("b")
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), thousands("s_acctbal"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), thousands("c_acctbal"), "c_mktsegment")
    return resolve.unique_matches(left, right, ["k", "b"], prefer=F.col("c_mktsegment") == "BUILDING")


@add("""SELECT a.p_partkey AS id, b.p_partkey AS base FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand <> b.p_brand AND a.p_type = b.p_type""")
def override_match(spark, sf_dir):
    """Members override a base's member of the same name whose parameter types are equal arrays."""
    p = table(spark, sf_dir, "part").withColumn("types", F.array(F.col("p_type"), F.col("p_size").cast("string")))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.types") == F.col("b.types")) & (F.col("a.p_brand") != F.col("b.p_brand")))
    return both.select(F.col("a.p_partkey").alias("id"), F.col("b.p_partkey").alias("base"))


@add("""SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN len(string_split(text, chr(10))) + 1 ELSE 1 END AS line, CASE WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN 'added' ELSE 'deleted' END AS change FROM documents
WHERE doc_id % 9 = 0 OR doc_id % 13 = 0 OR (doc_id % 7 = 1 AND contains(text, chr(10)))""")
def diff_lines(spark, sf_dir):
    """Some documents get a last line, some a first one, and some lose their first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    less = F.regexp_replace("content", r"^[^\n]*\n", "")
    edited = F.when(F.col("path") % 9 == 0, F.concat("content", F.lit("\nnew"))).when(F.col("path") % 13 == 0, F.concat(F.lit("new\n"), "content")).when(F.col("path") % 7 == 1, less).otherwise(F.col("content"))
    return intervals.changed_ranges(d, d.withColumn("content", edited))


_DIFF = f"""WITH s AS ({_SPANS}), r AS (SELECT o_orderkey AS file_id, 20 + o_custkey % 30 AS lo, 22 + o_custkey % 30 AS hi FROM orders), t AS (SELECT DISTINCT span_id FROM r JOIN s USING (file_id) WHERE lo <= "end" AND hi >= "start"),
e AS (SELECT l_orderkey * 10 + l_linenumber AS source, l_orderkey * 10 + l_linenumber + 1 AS target FROM lineitem), k AS (SELECT span_id, count(target) AS affected FROM t LEFT JOIN e ON source = span_id AND target IN (SELECT span_id FROM s) GROUP BY span_id)"""


@add(_DIFF + " SELECT span_id, affected FROM k WHERE affected > 0 ORDER BY affected DESC, span_id LIMIT 10")
def diff_impact(spark, sf_dir):
    """Changed line ranges meet symbols; what they call next to them is affected; isolated ones go and the first 10 stay."""
    s = _spans(spark, sf_dir)
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("range_id"), F.col("o_orderkey").alias("file_id"), (20 + F.col("o_custkey") % 30).alias("lo"), (22 + F.col("o_custkey") % 30).alias("hi"))
    touched = intervals.overlapping(r, s).select(F.col("span_id").alias("node")).distinct()
    e = s.select(F.col("span_id").alias("source"), (F.col("span_id") + 1).alias("target"), F.lit("calls").alias("kind")).join(s.select(F.col("span_id").alias("target")), "target", "left_semi")
    n = traverse.simple_paths(e, touched, 1).groupBy(F.col("seed").alias("span_id")).agg(F.count(F.lit(1)).alias("affected"))
    return n.orderBy(F.desc("affected"), "span_id").limit(10)


@add("""WITH r AS (SELECT event_id AS ref_id, event_type AS path, user_id AS "offset", event_type = 'view' AS local_only, CASE WHEN event_id % 6 <> 0 THEN event_id END AS target, event_id % 5 = 0 AND event_id % 6 <> 0 AS ambiguous, CASE event_id % 4 WHEN 0 THEN 'scope' WHEN 1 THEN 'import' ELSE 'heuristic' END AS evidence, CASE event_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 0.6 END AS confidence,
 CASE WHEN event_id % 3 = 0 THEN 'value' END AS receiver_kind, event_id % 11 = 0 AS overload FROM events),
q AS (SELECT ref_id, path, "offset", local_only, ambiguous, target, list_filter([CASE WHEN ambiguous THEN 'ambiguous' END, CASE WHEN receiver_kind = 'value' AND (target IS NULL OR NOT evidence IN ('scope', 'import') OR ambiguous) THEN 'receiver_or_dispatch' END, CASE WHEN overload AND target IS NOT NULL THEN 'overload' END], lambda v: v IS NOT NULL) AS early,
 list_filter([CASE WHEN target IS NULL THEN 'unresolved' END, CASE WHEN target IS NOT NULL AND (confidence < 0.9 OR NOT evidence IN ('scope', 'import')) THEN 'weak_evidence' END], lambda v: v IS NOT NULL) AS late FROM r),
z AS (SELECT *, CASE WHEN local_only THEN [] ELSE list_sort(list_concat(early, late)) END AS reasons FROM q)
SELECT ref_id, path, "offset", len(reasons) > 0 AS selected, CASE WHEN local_only THEN 3 WHEN ambiguous THEN 0 WHEN len(early) > 0 THEN 1 WHEN target IS NULL THEN 2 ELSE 3 END AS priority, CASE WHEN local_only THEN ['local_binding'] WHEN len(reasons) > 0 THEN reasons ELSE ['strong_evidence'] END AS reasons FROM z""")
def verify_policy(spark, sf_dir):
    e, i, no = table(spark, sf_dir, "events"), F.col("event_id"), F.lit(False)
    target = F.when(i % 6 != 0, i)
    on = lambda c: F.when(target.isNotNull(), c)
    rows = e.select(
        i.alias("ref_id"), F.col("event_type").alias("path"), F.col("user_id").alias("offset"), (F.col("event_type") == "view").alias("local_only"), target.alias("target"), on(i % 5 == 0).alias("ambiguous"),
        on(F.when(i % 4 == 0, "scope").when(i % 4 == 1, "import").otherwise("heuristic")).alias("evidence"), on(F.when(i % 4 == 0, 0.95).when(i % 4 == 1, 0.9).otherwise(0.6)).alias("confidence"), F.when(i % 3 == 0, "value").alias("receiver_kind"),
        on(F.when(i % 11 == 0, 2).otherwise(1)).alias("overloads"), no.alias("dynamic"), no.alias("generic"), no.alias("conditional"), no.alias("unsupported"),
    )
    return resolve.decisions(rows)


@add("""WITH t AS (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS path, l_linenumber % 2 AS place, l_suppkey % 3 > 0 AS own, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END AS s FROM lineitem WHERE l_quantity >= 45),
n AS (SELECT l_orderkey, count(DISTINCT path || '#' || place) AS n, bool_or(own) AS own, count(DISTINCT s) AS k, min(s) AS s FROM t GROUP BY l_orderkey)
SELECT o_orderkey AS ref_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN k = 0 AND NOT own THEN 'external' WHEN k = 0 THEN 'nonode' WHEN k = 1 THEN 'hit' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND k = 1 THEN s END AS symbol_id FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def answer_status(spark, sf_dir):
    """The dear lines of an order are the answers for it; parts are symbols, where they are known."""
    x = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    t = x.select(F.col("l_orderkey").alias("ref_id"), F.col("l_suppkey").cast("string").alias("target_path"), (F.col("l_linenumber") % 2).alias("target_at"), (F.col("l_suppkey") % 3 > 0).alias("in_project"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("symbol_id"))
    return resolve.answer_status(t, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id")))


@add("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name LIKE 'small%'), f AS (SELECT * FROM p WHERE p_partkey % 2 = 0), t AS (SELECT * FROM p WHERE p_partkey % 2 = 1)
SELECT f.p_partkey AS a, t.p_partkey AS b, CASE WHEN f.p_brand = t.p_brand AND f.p_type = t.p_type THEN 2 WHEN f.p_brand = t.p_brand THEN 1 ELSE 0 END AS proximity FROM f, t ORDER BY proximity DESC, a, b LIMIT 5""")
def pair_proximity(spark, sf_dir):
    """The nearest pairs of two candidate lists: same file, same directory, else anywhere. Near pairs are found by equal
    keys; the rest is filled from the first rows of both lists, which is where ties begin."""
    p = table(spark, sf_dir, "part").where(F.col("p_name").startswith("small")).select("p_partkey", "p_brand", "p_type")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), "p_brand", F.col("p_type").alias("ta"))
    b = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), "p_brand", F.col("p_type").alias("tb"))
    near = a.join(b, "p_brand").select("a", "b", F.when(F.col("ta") == F.col("tb"), 2).otherwise(1).alias("proximity"))
    first = lambda df, c: df.select(c).orderBy(c).limit(5)
    far = first(a, "a").join(first(b, "b"), F.lit(True)).join(near.select("a", "b"), ["a", "b"], "left_anti").withColumn("proximity", F.lit(0))
    return near.unionByName(far).orderBy(F.desc("proximity"), "a", "b").limit(5)


@add("""WITH h AS (SELECT p_partkey AS "key" FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30), r AS (SELECT l_partkey AS "key", l_suppkey AS node, 1 - l_discount AS confidence, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN h ON l_partkey = "key"),
o AS (SELECT "key", node, min_by(confidence, (ordinal, confidence)) AS confidence, min(ordinal) AS ordinal FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ordinal, node) AS k FROM o),
t AS (SELECT "key", node, confidence, CAST(s_suppkey % 2 = 0 AS INT) + CAST(s_nationkey % 3 = 0 AS INT) AS overlap FROM k JOIN supplier ON node = s_suppkey WHERE k <= 50)
SELECT "key", node, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY overlap DESC, confidence DESC, node) AS place FROM t) WHERE place <= 3""")
def supports_topk(spark, sf_dir):
    h = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select(F.col("p_partkey").alias("key"))
    words = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "readFile ").otherwise("readers "), F.when(F.col("s_nationkey") % 3 == 0, "the_path").otherwise("pathway"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), words.alias("text"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("node"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return retrieval.supports(h, r, s, "file path").select("key", "node", "overlap", F.col("place").cast("long").alias("place"))


@add("""WITH m AS (SELECT p_brand AS owner, p_name AS name, p_size AS params FROM part) SELECT owner, count(*) AS members, sum(params)::BIGINT AS params, list_sort(list(DISTINCT name)) AS names FROM m GROUP BY owner""")
def explain_members(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("owner")).agg(F.count(F.lit(1)).alias("members"), F.sum("p_size").alias("params"), F.array_sort(F.collect_set("p_name")).alias("names"))


@add(f"""WITH f AS ({FILES_SQL}), w AS (SELECT DISTINCT 'src0/en/doc_' || l_partkey || '.py' AS path FROM lineitem WHERE l_quantity = 50)
SELECT path, sha256('## ' || path || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10)) AS section FROM f WHERE path IN (SELECT path FROM w)""")
def dump_bundle(spark, sf_dir):
    """The files that a subgraph names, as sections of a Markdown bundle with fences longer than any run of backticks."""
    from graphloom.functions.text import fence

    named = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("src0/en/doc_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path")).distinct()
    f = files(spark, sf_dir).join(named, "path", "left_semi")
    mark = fence(F.col("content"))
    section = F.concat(F.lit("## "), "path", F.lit("\n\n"), mark, F.lit("\n"), "content", F.lit("\n"), mark, F.lit("\n"))
    return f.select("path", F.sha2(section.cast("binary"), 256).alias("section"))


# Retrieval quality.

_HITS = """h AS (SELECT lang AS query_id, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents), l AS (SELECT lang AS query_id, doc_id AS item, CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 WHEN toxic = 0 THEN 1 ELSE 0 END AS grade FROM labels JOIN documents USING (doc_id))"""


def _hits(spark, sf_dir):
    """Documents ranked by length stand for a ranking; labels give the grades."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    hits = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item"), F.row_number().over(w).alias("place"))
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 2).when(F.col("toxic") == 0, 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").join(d.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item"), grade.alias("grade"))
    return hits, labels


@add(f"""WITH {_HITS}, g AS (SELECT h.*, coalesce(l.grade, 0) AS grade FROM h LEFT JOIN l USING (query_id, item)), i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS i FROM l WHERE grade > 0), d AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(i + 1)) AS ideal FROM i WHERE i <= 5 GROUP BY query_id),
s AS (SELECT query_id, min(place) FILTER (grade = 3) AS first, sum(CASE WHEN place <= 5 THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS dcg FROM g GROUP BY query_id)
SELECT query_id, coalesce((first <= 1)::INT, 0) AS hit1, coalesce((first <= 5)::INT, 0) AS hit5, coalesce(round(1.0::DOUBLE / first, 6), 0) AS mrr, coalesce(round(dcg / ideal, 6), 0) AS ndcg5 FROM s LEFT JOIN d USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    return retrieval.metrics(*_hits(spark, sf_dir))


@add("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def group_latency(spark, sf_dir):
    return retrieval.latencies(table(spark, sf_dir, "events"), "event_type", "value")


_OV = """SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS item, l_orderkey % 40 AS file, ['class', 'struct', 'method', 'function'][1 + CAST(l_quantity AS BIGINT) % 4] AS kind, l_linenumber * 10 AS "start", l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS "end",
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS place FROM lineitem"""


@add(f"""WITH h AS ({_OV}) SELECT query_id, item, place FROM h a WHERE NOT (kind IN ('class', 'struct') AND EXISTS (SELECT 1 FROM h b WHERE a.query_id = b.query_id AND a.file = b.file AND b.kind IN ('function', 'method') AND abs(a.place - b.place) <= 5 AND b."end" > b."start" AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.8 * (b."end" - b."start")))""")
def overlap_suppress(spark, sf_dir):
    x, start = table(spark, sf_dir, "lineitem"), (F.col("l_linenumber") * 10).cast("long")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    kind = F.element_at(F.array(*map(F.lit, ("class", "struct", "method", "function"))), (1 + F.col("l_quantity").cast("long") % 4).cast("int"))
    h = x.select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_orderkey") % 40).alias("file"), kind.alias("kind"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.row_number().over(w).cast("long").alias("place"))
    return retrieval.overlap_suppressed(h).select("query_id", "item", "place")


@add("""WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), l AS (SELECT p_partkey, 1 + p_partkey % 50 AS s, CASE WHEN p_size % 2 = 0 THEN 'must_have' ELSE 'must_not_have' END AS polarity FROM part), h AS (SELECT polarity, e.l_partkey IS NOT NULL AS found FROM l LEFT JOIN e ON p_partkey = l_partkey AND s = l_suppkey),
n AS (SELECT count_if(polarity = 'must_have') AS required, count_if(polarity = 'must_have' AND found) AS hits, count_if(polarity = 'must_not_have' AND found) AS forbidden FROM h) SELECT required, hits, forbidden, round(hits::DOUBLE / nullif(hits + forbidden, 0), 6) AS precision, round(hits::DOUBLE / nullif(required, 0), 6) AS recall FROM n""")
def edge_precision(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (1 + F.col("p_partkey") % 50).alias("target"), F.when(F.col("p_size") % 2 == 0, "must_have").otherwise("must_not_have").alias("polarity"))
    return retrieval.edge_accuracy(e, labels)


@add("""WITH s AS (SELECT p_partkey AS "key", row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part), t AS (SELECT * FROM s WHERE place <= 32), n AS (SELECT l_suppkey + 1000000 AS node, min(place) AS place FROM lineitem JOIN t ON l_partkey = "key" GROUP BY 1)
SELECT node, place FROM n ORDER BY place, node LIMIT 50""")
def graph_expansion(spark, sf_dir):
    top = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_retailprice").orderBy(F.desc("p_retailprice"), "key").limit(32)
    seeds = top.select("key", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "key")).cast("long").alias("place"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1000000).alias("target"))
    return retrieval.expanded(seeds, e)


@add(f"""WITH s AS ({_SPANS}) SELECT l_orderkey AS file_id, l_linenumber * 11 AS line FROM lineitem x WHERE EXISTS (SELECT 1 FROM s WHERE s.file_id = x.l_orderkey AND s."end" - s."start" > 20 AND x.l_linenumber * 11 BETWEEN s."start" AND s."end")""")
def eligible_lines(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 11).alias("line"))
    s = _spans(spark, sf_dir).where("end - start > 20").select("file_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    return search.line_eligible(hits, s)
