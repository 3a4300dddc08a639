"""Hand-made cases where a rule is easily read otherwise."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import terms, trimmed
from graphloom.operators import assemble, bm25, documents, explain, graph, ingest, intervals, resolve, retrieval, search, traverse
from graphloom.plans import parse


def test_only_answers_count_as_hits(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, item string, place int")
    labels = spark.createDataFrame([("q", "a", 2), ("q", "b", 3), ("q", "c", 1)], "query_id string, item string, grade int")
    r = retrieval.metrics(hits, labels).first()
    assert (r["hit1"], r["hit5"], r["mrr"]) == (0, 1, 0.5) and 0 < r["ndcg5"] < 1


def test_types_give_way_to_their_members(spark):
    rows = [("q", 1, "f", "class", 0, 100, 1), ("q", 2, "f", "method", 10, 20, 4), ("q", 3, "f", "method", 10, 20, 5), ("q", 4, "f", "class", 0, 100, 12), ("q", 5, "g", "struct", 0, 100, 6), ("q", 6, "f", "struct", 15, 40, 7)]
    df = spark.createDataFrame(rows, "query_id string, item int, file string, kind string, start int, end int, place int")
    assert sorted(r["item"] for r in retrieval.overlap_suppressed(df).collect()) == [2, 3, 4, 5, 6]


def test_lines_are_found_by_terms(spark):
    df = spark.createDataFrame([(1, "a pathway\n\tread the Path \nfile path\n"), (2, "readPath()")], "id int, text string")
    got = {(r["id"], r["line"]): (r["snippet"], r["full"], r["coverage"]) for r in search.grep(df, "file path").collect()}
    assert got == {(1, 2): ("read the Path", 0, 1), (1, 3): ("file path", 1, 2), (2, 1): ("readPath()", 0, 1)}
    assert search.query_terms("parseHTTPResponse2Text the ÜberCode") == sorted(["parse", "httpresponse2", "text", "über", "code"])
    best = search.best_excerpt(df, ["path", "file"]).collect()
    assert {(r["id"], r["line"], r["hits"], r["start_line"]) for r in best} == {(1, 3, 2, 2), (2, 1, 1, 1)}


def test_case_rules_of_literals_and_names(spark):
    lit = spark.createDataFrame([("ABC É",), ("abc é",)], "value string")
    assert search.literal_search(lit, "abc é").count() == 1 and search.literal_search(lit, "aBC").count() == 2
    names = spark.createDataFrame([("ab",), ("reader_of_files",), ("raeder",)], "name string")
    assert {r["name"] for r in search.fuzzy_search(names, "reader").collect()} == {"reader_of_files", "raeder"}


def test_several_targets_are_ambiguous(spark):
    t = spark.createDataFrame([(1, "a", 1, 7, True), (1, "a", 2, 7, True), (2, "a", 1, 7, True), (2, "a", 1, 7, True), (3, "x", 1, None, False), (4, "a", 1, None, True)], "ref_id int, target_path string, target_at int, symbol_id int, in_project boolean")
    got = {r["ref_id"]: (r["status"], r["symbol_id"]) for r in resolve.answer_status(t, spark.range(1, 6).withColumnRenamed("id", "ref_id")).collect()}
    assert got == {1: ("ambiguous", None), 2: ("hit", 7), 3: ("external", None), 4: ("nonode", None), 5: ("unresolved", None)}


def test_answers_have_one_label(spark):
    df = spark.createDataFrame([(0, None), (2, 0.1), (2, 0.9), (1, None)], "n int, best double")
    assert [r[0] for r in df.select(retrieval.quality(F.col("n"), F.col("best"), 0.5)).collect()] == ["empty", "weak", "candidate", "weak"]
    assert df.select(retrieval.quality(F.col("n"), F.col("best"), None).alias("q")).where("q = 'candidate'").count() == 3


def test_related_symbols(spark):
    hits = spark.createDataFrame([("h",)], "key string")
    rel = spark.createDataFrame([("h", f"n{i}", 0.5, i) for i in range(60)] + [("h", "n0", 0.9, 70)], "key string, node string, confidence double, ordinal int")
    text = spark.createDataFrame([(f"n{i}", "pathway" if i == 1 else "the path" if i in (2, 55) else "x y") for i in range(60)], "node string, text string")
    got = [r["node"] for r in retrieval.supports(hits, rel, text, "file path").orderBy("place").collect()]
    assert got == ["n2", "n0", "n1"], "n55 is beyond the first 50, n1 holds no term"


def test_targets_by_any_path_suffix(spark):
    df = spark.createDataFrame([("sym:a#b", "b", "src/foo.rs", "m::b")], "id string, label string, path string, qualified string")
    assert [explain.find_targets(df, q).count() for q in ("oo.rs", "m.b", "b", "x")] == [1, 1, 1, 0]


def test_scanned_files_are_those_in_scope(spark):
    status = spark.createDataFrame([("added",), ("unchanged",), ("removed",), ("out_of_scope",)], "status string")
    assert tuple(ingest.sync_counts(status).first()) == (2, 1, 0, 1, 1, 1)


def test_cap_takes_edges_along(spark):
    nodes = spark.createDataFrame([("file:f", "file"), ("sym:a", "function"), ("sym:b", "function"), ("sym:c", "function")], "id string, kind string")
    edges = spark.createDataFrame([("sym:a", "sym:b", "calls"), ("sym:c", "file:f", "calls"), ("file:f", "ext:x", "imports")], "source string, target string, kind string")
    kept, links = graph.capped(nodes, edges, 2)
    assert {r["id"] for r in kept.collect()} == {"file:f", "sym:c"} and {tuple(r)[:2] for r in links.collect()} == {("sym:c", "file:f"), ("file:f", "ext:x")}
    assert graph.capped(nodes, edges, 0)[0].count() == 4


def test_snippets_are_trimmed(spark):
    files = spark.createDataFrame([("p", "\t\ta b　\r\n \n")], "path string, content string")
    edges = spark.createDataFrame([("p", 1), ("p", 2), ("p", 9), ("q", 1), ("p", 0)], "path string, line int")
    got = {(r["path"], r["line"]): r["snippet"] for r in explain.snippets(edges, files).collect()}
    assert got == {("p", 1): "a b", ("p", 2): None, ("p", 9): None, ("q", 1): None, ("p", 0): None}
    assert spark.range(1).select(trimmed(F.lit("\x0b x\x85"))).first()[0] == "x"


def test_chains_and_closures_of_any_length(spark):
    s = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(25)] + [(100, "x", 101), (101, "y", 100)], "id long, name string, parent long")
    got = {r["id"]: r["owners"] for r in traverse.owner_chains(s).collect()}
    assert got[24] == [f"n{i}" for i in range(24)] and got[100] == ["y"]
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 18)], "source long, target long")
    all_pairs = {tuple(r) for r in traverse.closure(e).collect()}
    assert len(all_pairs) == len(traverse.closure(e).collect()) and (0, 20) in all_pairs and (19, 18) in all_pairs and (18, 17) not in all_pairs
    roots = spark.createDataFrame([(17,)], "node long")
    assert {tuple(r) for r in traverse.closure(e, roots).collect()} == {p for p in all_pairs if p[0] == 17}
    hops = spark.createDataFrame([(1, "T0", [f"f{i}" for i in range(7)])], "id int, type string, hops array<string>")
    fields = spark.createDataFrame([(f"T{i}", f"f{i}", f"T{i + 1}") for i in range(7)], "owner string, name string, type string")
    assert explain.field_chain(hops, fields).first()["type"] == "T7"


def test_an_inserted_line_changes_no_other():
    assert list(intervals.line_changes("a\nb\nc", "new\na\nb\nc")) == [(1, "added")]
    assert list(intervals.line_changes("a\nb\nc", "a\nx\ny\nc")) == [(2, "changed"), (3, "added")]
    assert list(intervals.line_changes("a\nb", None)) == [(1, "deleted"), (2, "deleted")] and list(intervals.line_changes(None, "a")) == [(1, "added")]


def test_ranges_meet_once(spark):
    r = spark.createDataFrame([(1, 1, 5, 900), (2, 1, 300, 300)], "range_id int, file_id int, lo int, hi int")
    s = spark.createDataFrame([(1, 1, 0, 1000), (2, 1, 250, 310), (3, 2, 0, 9)], "span_id int, file_id int, start int, end int")
    assert sorted((x["range_id"], x["span_id"], x["place"]) for x in intervals.overlapping(r, s, bucket=16).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 2), (2, 2, 1)]


@pytest.mark.parametrize(("language", "specifier", "name", "importer", "first"), [
    ("rust", "crate::a::b", "C", "src/x/y.rs", ["src/a/b/C.rs", "src/a/b/C/mod.rs", "a/b/C.rs", "src/a/b.rs"]),
    ("rust", "super::m", None, "src/x/y.rs", ["src/m.rs", "src/m/mod.rs", "m.rs", "src.rs"]),
    ("rust", "self::m", None, "src/x/y.rs", ["src/x/m.rs", "src/x/m/mod.rs", "x/m.rs", "src/x.rs"]),
    ("java", "a.b.C", "C", "x.java", ["a/b/C.java", "a/b/C.kt", "src/main/java/a/b/C.java"]),
    ("java", "a.b.*", None, "x.java", []),
    ("javascript", "../q", None, "web/a/b.ts", ["web/q", "web/q.ts", "web/q.tsx"]),
    ("javascript", "react", None, "web/a/b.ts", []),
    ("python", "..q.r", None, "p/s/m.py", ["p/q/r.py", "p/q/r/__init__.py"]),
    ("c", "a/b.h", None, "src/m.c", ["src/a/b.h", "a/b.h", "include/a/b.h"]),
])
def test_where_imports_may_lie(spark, language, specifier, name, importer, first):
    df = spark.createDataFrame([(language, importer, specifier, name)], "f string, i string, s string, n string")
    got = df.select(intervals.import_candidates(F.col("f"), F.col("i"), F.col("s"), F.col("n"))).first()[0]
    assert got[: len(first)] == first and (first or not got)


def refs_and_symbols(spark, refs, symbols):
    r = {"ref_id": 1, "name": "f", "ref_kind": "call", "receiver_kind": "none", "receiver": None, "receiver_type": None, "receiver_bases": [], "owner": None, "package": None, "file": "a", "family": "x", "arg_count": None, "local_only": False, "scope_target": None, "import_targets": [], "namespaces": [], "reachable": [], "precise_status": None, "precise_target": None, "precise_confidence": None, "language": "java", "at": None, "argument_types": None}
    s = {"symbol_id": 1, "name": "f", "qualified": "f", "kind": "function", "owner": None, "package": None, "path": "b", "family": "x", "exported": False, "params": None, "start_byte": 0, "visibility": None, "param_types": None, "takes_self": None, "internal": None}
    rs = "ref_id int, name string, ref_kind string, receiver_kind string, receiver string, receiver_type string, receiver_bases array<string>, owner string, package string, file string, family string, arg_count int, local_only boolean, scope_target int, import_targets array<int>, namespaces array<string>, reachable array<string>, precise_status string, precise_target int, precise_confidence double, language string, at long, argument_types array<string>"
    ss = "symbol_id int, name string, qualified string, kind string, owner string, package string, path string, family string, exported boolean, params int, start_byte int, visibility string, param_types array<string>, takes_self boolean, internal boolean"
    made = lambda base, rows, schema, key: spark.createDataFrame([tuple((base | {key: i + 1} | x).values()) for i, x in enumerate(rows)], schema)
    got = resolve.resolved(made(r, refs, rs, "ref_id"), made(s, symbols, ss, "symbol_id"))
    return {x["ref_id"]: x for x in got.collect()}


def test_resolution_rules(spark):
    symbols = [
        {"owner": "T", "path": "m"}, {"owner": "U", "path": "b"}, {"name": "g", "visibility": "private", "path": "a"}, {"name": "g", "visibility": "package", "package": "p", "path": "c"},
        {"name": "h", "param_types": ["int"], "params": 1}, {"name": "h", "param_types": ["str"], "params": 1}, {"name": "I", "qualified": "I", "kind": "interface"}, {"name": "k", "owner": "I"}, {"name": "k", "owner": "I", "path": "z"}, {"name": "q", "owner": "ns::A"}, {"name": "q", "owner": "B"},
    ]
    refs = [
        {"receiver_kind": "value", "receiver": "m", "receiver_type": "T", "namespaces": ["m"]}, {"name": "g", "file": "a"}, {"name": "g", "package": "p", "file": "z"}, {"name": "h", "arg_count": 1, "argument_types": ["str"]},
        {"name": "k", "receiver_kind": "value", "receiver": "x", "receiver_type": "I"}, {"name": "q", "receiver_kind": "path", "receiver": "A", "language": "cpp", "reachable": ["b"]}, {"receiver_kind": "value", "receiver": "x"}, {"name": "g", "file": "other"},
    ]
    got = refs_and_symbols(spark, refs, symbols)
    assert (got[1]["target"], got[1]["evidence"], got[1]["alternatives"]) == (1, "import", [])
    assert got[2]["target"] == 3 and got[3]["target"] == 4 and got[4]["target"] == 6
    assert got[5]["ambiguous"] and got[5]["evidence"] == "receiver" and len(got[5]["alternatives"]) == 1
    assert (got[6]["target"], got[6]["evidence"], got[6]["confidence"]) == (10, "qualified_name", 0.6)
    assert got[7]["ambiguous"] and len(got[7]["alternatives"]) == 1, "an unknown receiver keeps all others"
    assert 8 not in got


def test_scopes_settle_names():
    got = parse.parse_text("import os\ndef f(x, g):\n    g(x)\n    h(1)\n    def h(y): return y\n    return k()\ndef k(): return os.getcwd()\n", "python")
    calls = {(r["name"], r["local_only"], got["symbols"][r["scope_symbol"]]["name"] if r["scope_symbol"] is not None else None) for r in got["refs"]}
    assert calls == {("g", True, None), ("h", False, "h"), ("k", False, "k"), ("getcwd", False, None)}
    got = parse.parse_text("fn a(cb: Fun) { let z = 1; cb(z); b(); }\nfn b() {}\nfn b2() { z(); }", "rust")
    calls = {(r["name"], r["local_only"], r["scope_symbol"] is not None) for r in got["refs"] if r["ref_kind"] == "call"}
    assert calls == {("cb", True, False), ("b", False, True), ("z", False, False)} and any(r["ref_kind"] == "type" and r["name"] == "Fun" for r in got["refs"])
    java = parse.parse_text("class A extends Base {\n  public int run(Request r, int n) { int local = n; return go(r); }\n  int go(Request r) { return 1; }\n}", "java")
    assert {(b["name"], b["kind"]) for b in java["bindings"] if b["kind"] in ("param", "local")} == {("r", "param"), ("n", "param"), ("local", "local")}
    assert {r["name"] for r in java["refs"] if r["ref_kind"] == "type"} == {"Base", "Request"}


def test_long_argument_lists_are_counted():
    source = "fn f() { g(" + ", ".join(f"a{i}" for i in range(9000)) + ") }"
    assert [r["arg_count"] for r in parse.parse_text(source, "rust")["refs"] if r["ref_kind"] == "call"] == [9000]


def test_graph_of_two_languages(spark):
    files = [("src/a.rs", "rust", "use crate::b::make;\npub struct T;\nimpl Show for T { fn show(&self) { make() } }\n"), ("src/b.rs", "rust", "pub trait Show { fn show(&self); }\npub fn make() {}\n"), ("web/x.ts", "typescript", "import { y } from './y';\nimport z from 'lib';\nexport function run(a: number) { y(a); z(); }\n"), ("web/y.ts", "typescript", "export function y(b: number) { return b; }\n")]
    parsed = parse.parsed(spark.createDataFrame(files, "path string, language string, text string"))
    nodes, edges = assemble.built(parsed)
    short = lambda x: x.split("#")[-1].split("@")[0]
    got = {(short(r["source"]), short(r["target"]), r["kind"], r["confidence"]) for r in edges.where("kind <> 'contains'").collect()}
    assert {("show", "make", "calls", 0.9), ("T", "Show", "implements", 1.0), ("run", "y", "calls", 0.9), ("file:src/a.rs", "file:src/b.rs", "imports", 1.0), ("file:web/x.ts", "file:web/y.ts", "imports", 1.0), ("file:web/x.ts", "ext:lib", "imports", 1.0)} <= got
    assert nodes.where("kind = 'external'").count() == 1 and nodes.select("id").distinct().count() == nodes.count()


def test_documents_take_their_comment():
    text = "import a\n\n# About f,\n# at length.\n\ndef f(): pass\n\nx = 1\n"
    rows = list(documents.documents_of("p.py", text, [s for s in parse.parse_text(text, "python")["symbols"] if s["kind"] == "function"]))
    assert [(r[2], r[3], r[7], r[8]) for r in rows] == [("f", "function", 3, 6), ("p.py", "file", 1, 3), ("p.py", "file", 6, 9)] and rows[0][9].startswith("# About f")


def test_postings_count_in_the_row(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None)], "key int, text string")
    df = df.withColumn("text", F.regexp_replace("text", "([abc])", "$1$1"))
    assert {tuple(r) for r in bm25.postings(df, F.col("text")).collect()} == {(1, 5, "aa", 1), (1, 5, "bb", 3), (1, 5, "cc", 1)}
    assert [tuple(r) for r in df.select(terms(F.col("text"))).where("false").collect()] == []


def test_summaries_leave_bodies_out():
    text = "impl P {\n    /// é\n    fn a(&self) -> u8 { b(1) }\n    const X: u8 = 1;\n    fn c() {}\n}\nfn d() { 2 }\n"
    rows = list(documents.summaries_of(text, parse.parse_text(text, "rust")["symbols"], "rust"))
    assert [(r[0], r[1]) for r in rows] == [("P", "impl")] and rows[0][3] == f"impl P {{\n    /// é\n    fn a(&self) -> u8 {{{documents.MARK}}}\n    const X: u8 = 1;\n    fn c() {{}}\n}}"
