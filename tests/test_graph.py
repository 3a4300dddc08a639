"""Graph operators and walks on small graphs."""

import random

from pyspark.sql import functions as F

from graphloom.operators import community, graph, intervals, resolve, sinks, traverse


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, c, n) for a, b, k, c, n in rows], "source string, target string, kind string, confidence double, line long")


def test_edge_line_is_that_of_the_surest(spark):
    e = edges(spark, [("a", "b", "calls", 0.5, 1), ("a", "b", "calls", 0.9, 7), ("a", "b", "calls", 0.9, 4)])
    assert [tuple(r) for r in graph.aggregated(e).collect()] == [("a", "b", "calls", 0.9, 4, 3)]


def test_degree_skips_contains(spark):
    e = edges(spark, [("a", "b", "calls", 1.0, 1), ("f", "a", "contains", 1.0, None)])
    assert {tuple(r) for r in graph.degree(e).collect()} == {("a", 1), ("b", 1)}


def test_shortest_and_unreachable(spark):
    e = edges(spark, [("a", "b", "calls", 1.0, 1), ("b", "c", "calls", 1.0, 1), ("a", "c", "calls", 1.0, 1), ("c", "d", "calls", 1.0, 1)])
    pairs = spark.createDataFrame([("a", "d"), ("d", "a")], "start string, goal string")
    got = {(r["start"], r["goal"]): r["hops"] for r in traverse.shortest(e, pairs).collect()}
    assert got == {("a", "d"): ["a", "c", "d"], ("d", "a"): None}


def test_focus_without_seeds_is_everything(spark):
    n = spark.createDataFrame([("x", "x"), ("y", "y")], "id string, label string")
    e = edges(spark, [("x", "y", "calls", 1.0, 1)])
    same, _ = traverse.focused(n, e, "nothing", 1)
    assert same.count() == 2
    near, kept = traverse.focused(n.union(spark.createDataFrame([("z", "z")], "id string, label string")), e, "x", 1)
    assert {r["id"] for r in near.collect()} == {"x", "y"} and kept.count() == 1


def test_simple_paths_do_not_loop(spark):
    e = edges(spark, [("a", "b", "calls", 1.0, 1), ("b", "a", "calls", 1.0, 1), ("b", "c", "imports", 1.0, 1)])
    got = traverse.simple_paths(e, spark.sql("SELECT 'a' AS node"), 3)
    assert sorted(tuple(r["path"]) for r in got.collect()) == [("a", "b"), ("a", "b", "c")]


def test_louvain_finds_two_cliques():
    links = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 1.0)]
    random.Random(1).shuffle(links)
    found = community.louvain(links)
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and len({found[f"b{i}"] for i in range(4)}) == 1 and found["a0"] != found["b0"]


def test_labels_are_numbered(spark):
    m = spark.createDataFrame([("src/a", 0, 2), ("src/b", 0, 2), ("src/c", 1, 2), ("src/d", 1, 2), ("x", 2, 2), ("y", 2, 2)], "id string, community long, size long")
    assert {tuple(r) for r in community.labels(m).collect()} == {(0, "src"), (1, "src (2)"), (2, "x")}


def test_externals(spark):
    n = spark.createDataFrame([("a", "file"), ("e1", "external"), ("e2", "external")], "id string, kind string")
    e = edges(spark, [("a", "e1", "imports", 1.0, 1)])
    assert {r["id"] for r in graph.pruned_externals(n, e, True)[0].collect()} == {"a", "e1"}
    assert [x.count() for x in graph.pruned_externals(n, e, False)] == [1, 0]


def test_precise_answers_win(spark):
    refs = spark.createDataFrame(
        [(1, "hit", 7, None, False), (2, "external", None, None, False), (3, None, None, None, False), (4, None, None, None, True)],
        "ref_id long, precise_status string, precise_target long, precise_confidence double, local_only boolean",
    ).selectExpr("*", "'run' name", "'call' ref_kind", "'none' receiver_kind", "cast(null as string) receiver", "cast(null as string) receiver_type", "cast(array() as array<string>) receiver_bases", "cast(null as string) owner", "'p' package", "'f' file", "'go' family", "1 arg_count", "cast(null as long) scope_target", "array(9L) import_targets", "cast(array() as array<string>) namespaces", "array('g') reachable")
    symbols = spark.createDataFrame([(7, "run", "A.run", "function", None, "q", "f", "go", True, 1, 0), (9, "run", "B.run", "function", None, "q", "g", "go", True, 1, 0)], "symbol_id long, name string, qualified string, kind string, owner string, package string, path string, family string, exported boolean, params int, start_byte int")
    got = {r["ref_id"]: (r["target"], r["evidence"], r["confidence"]) for r in resolve.resolved(refs, symbols).collect()}
    assert got == {1: (7, "lsp", 1.0), 3: (9, "import", 0.9)}


def test_base_types(spark):
    from pyspark.sql import functions as F

    cases = {"&mut Gauge<'a, T>": "Gauge", "&'a str": "str", "std::fmt::Error": "Error", "List<String>": "List", "String?": "String", "int[]": "int"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", resolve.base_type(F.col("t")).alias("b"))
    assert {r["t"]: r["b"] for r in df.collect()} == cases


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", 'say "x"')], "id string, label string")
    e = edges(spark, [("a", "a</script>", "calls", 1.0, 1)])
    assert '\\"x\\"' in sinks.dot(n, e) and "</script>\"" not in sinks.page(n, e)
    sinks.write_json(n, e, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/edges").count() == 1


def test_imports_are_not_broadcast_with_their_candidates(spark):
    """Dozens of candidates for each import: both sides are sorted, and imports are dealt out before they grow."""
    imports = spark.range(1000).select(F.col("id").alias("import_id"), F.lit("java").alias("family"), F.lit("src/A.java").alias("importer"), F.format_string("com.K%d.make", F.col("id") % 50).alias("specifier"), F.lit("make").alias("name")).coalesce(1)
    files = spark.range(50).select(F.format_string("kotlin/com/K%d.kt", "id").alias("path"))
    found = intervals.first_existing(imports, intervals.import_candidates(F.col("family"), F.col("importer"), F.col("specifier"), F.col("name")), files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "RoundRobinPartitioning" in plan
    assert {r["import_id"]: r["path"] for r in found.collect()} == {k: f"kotlin/com/K{k % 50}.kt" for k in range(1000)}


def _methods(spark, n):
    """Owners with a method of one name each, and calls of it on values of a known type."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    k = spark.range(n).select(F.col("id").cast("string").alias("k"))
    symbols = k.select(F.concat(F.lit("s"), "k").alias("symbol_id"), F.lit("size").alias("name"), F.concat(F.lit("O"), "k", F.lit(".size")).alias("qualified"), F.lit("method").alias("kind"), F.concat(F.lit("O"), "k").alias("owner"), F.lit("p").alias("package"), F.concat(F.lit("f"), "k").alias("path"), F.lit("java").alias("family"), F.lit(True).alias("exported"), F.lit(0).alias("params"), F.lit(1).alias("start_byte"), (F.col("k") == "7").alias("extension"))
    refs = k.select(F.concat(F.lit("r"), "k").alias("ref_id"), F.lit("size").alias("name"), F.lit("call").alias("ref_kind"), F.lit("value").alias("receiver_kind"), F.lit("it").alias("receiver"), F.concat(F.lit("O"), "k").alias("receiver_type"), F.when(F.col("k") == "3", F.array(F.lit("O4"), F.lit("O3"))).otherwise(empty).alias("receiver_bases"), none.alias("owner"), F.lit("q").alias("package"), F.lit("g").alias("file"), F.lit("java").alias("family"), F.lit(0).alias("arg_count"), F.lit(False).alias("local_only"), none.alias("scope_target"), empty.alias("import_targets"), empty.alias("namespaces"), empty.alias("reachable"), none.alias("precise_status"), none.alias("precise_target"), F.lit(None).cast("double").alias("precise_confidence"))
    return refs, symbols


def test_values_of_known_types_meet_their_own_members(spark):
    """One name of n types makes n pairs, one more for a base, and those with the extension; not n times n."""
    refs, symbols = _methods(spark, 200)
    pairs = [(r["ref_id"], r["s_symbol_id"]) for r in resolve.candidates(refs, symbols).collect()]
    assert len(pairs) == len(set(pairs)) == 200 + 1 + 199
    assert {r["ref_id"]: r["target"] for r in resolve.resolved(refs, symbols).collect()} == {f"r{k}": f"s{k}" for k in range(200)}


def test_resolution_in_steps_is_that_of_all_pairs(spark, monkeypatch):
    """However many pairs share a name; the first step alone looks at a small part of them."""
    from graphloom.queries import resolution

    sf = "/root/testdata/sf0.01"
    refs, symbols = resolution._refs(spark, sf), resolution._symbols(spark, sf)
    whole = sorted(map(repr, resolve.ranked(resolve.scored(resolve.candidates(refs, symbols))).withColumn("score", F.col("score").cast("int")).collect()))
    monkeypatch.setattr(resolve, "MANY_PAIRS", 0)
    steps = resolve._settled(refs, symbols)
    assert len(steps) == 3 and all(s.count() for s in steps)
    assert sorted(map(repr, resolve.resolved(refs, symbols).collect())) == whole
    assert resolve.candidates(refs, symbols, "near").count() * 4 < resolve.candidates(refs, symbols).count()


def test_texts_are_parsed_in_many_tasks(spark):
    from graphloom.queries import assembly

    assert assembly.module_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
