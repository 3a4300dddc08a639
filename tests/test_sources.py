"""Source trees, notebooks, config files, parsers and the sync stream."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import ingest, intervals, search
from graphloom.plans import parse
from graphloom.sources import project, tree
from graphloom.sources.toml import toml_keys
from graphloom.streaming import sync


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("glob", "crosses", "path", "hit"), [("src/*.rs", False, "src/a/b.rs", False), ("src/*.rs", True, "src/a/b.rs", True), ("**/b.rs", False, "b.rs", True), ("src/**", False, "src/a/b", True), ("{a,b}.py", False, "b.py", True), ("[!a].py", False, "a.py", False), ("?.py", False, "/.py", False)])
def test_globs(spark, glob, crosses, path, hit):
    assert one(spark, path, lambda c: c.rlike(paths.glob_regex(glob, crosses=crosses))) is hit


@pytest.mark.parametrize(("path", "language"), [("a/x.C", "cpp"), ("a/x.c", "c"), ("X.RS", "rust"), ("a.tsx", "typescript"), (".rs", None), ("noext", None)])
def test_languages(spark, path, language):
    assert one(spark, path, paths.language_of) == language


@pytest.mark.parametrize(("s", "want"), [("parseHTTPResponse2Text", ["parse", "httpresponse2", "text"]), ("the a_b foo_bar", ["foo", "bar"]), (None, []), ("é ünïCode", ["ünï", "code"])])
def test_terms(spark, s, want):
    assert one(spark, s, text.terms) == want


def test_fence_is_longer(spark):
    assert one(spark, "a ```` b", text.fence) == "`" * 5 and one(spark, "a", text.fence) == "```"


def test_walk(spark, tmp_path):
    for name in ("src/a.py", "src/b.min.js", "node_modules/x.js", ".git/c.py", "doc/n.ipynb", "skip/d.py", "LICENSE"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    book = {"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["a\n", "b"], "outputs": []}]}
    (tmp_path / "doc/n.ipynb").write_text(json.dumps(book))
    t = tree.read_tree(spark, str(tmp_path), "skip/\n!keep\n")
    assert {r["path"] for r in t.select("path").collect()} == {"src/a.py", "src/b.min.js", "doc/n.ipynb", "LICENSE"}
    assert {r["path"] for r in tree.source_files(t).select("path").collect()} == {"src/a.py"}
    bundle = {r["path"]: r["text"] for r in tree.bundle_files(t, 10).collect()}
    assert bundle["doc/n.ipynb"] == "# T\n\n```python\na\nb\n```" and bundle["LICENSE"] is None and bundle["src/a.py"] == "x = 1\n"


def test_toml(spark):
    src = 'a = 1 # c\n[x."y"]\n"b" = "#no"\n[[t]]\nc = """\ntwo words = 3\n"""\nd="[x]"'
    got = toml_keys(spark.createDataFrame([("p", src)], "path string, text string"))
    assert [(r["value"], r["line"]) for r in got.orderBy("line").collect()] == [("a", 1), ("x.y.b", 3), ("t.c", 5), ("t.d", 8)]


def test_project():
    p = project.read_project('[sync]\nlanguages = ["rust", "py"]\n[graph]\nmin_confidence = 0.5\nkinds = ["calls"]\n[scope.categories]\ntests = ["tests/**"]\n[precise]\nenabled = true\n')
    assert p.graph.min_confidence == 0.5 and p.graph.depth == 2 and p.graph.max_nodes == 4000 and p.graph.kinds == ["calls"] and p.sync.languages == ["rust", "python"] and p.sync.max_file_kb == 512
    for bad in ("nothing = 1", "[sync]\nlanguages = 3", "[graph]\nx = 1", "[graph]\nmin_confidence = 2", "[sync]\nmax_file_kb = 0", "[graph]\ndepth = true", '[sync]\nlanguages = ["cobol"]'):
        with pytest.raises(ValueError):
            project.read_project(bad)


def test_build_context(spark):
    got = project.build_context(spark, json.dumps([{"file": "a.h", "command": "cc -x c++ -Iinc -isystem sys a.h"}, {"file": "b.c", "arguments": ["cc", "-I", "q"]}]))
    assert {(r["file"], r["language"], tuple(r["include_paths"])) for r in got.collect()} == {("a.h", "cpp", ("inc", "sys")), ("b.c", "c", ("q",))}


SOURCES = {
    "rust": ("impl P { pub fn new(a: u8) -> P { go(a, \"x\") } }\nmod m;", {("P", "impl", None), ("new", "method", 1), ("m", "module", None)}, {("go", 2)}),
    "go": ("package m\nfunc (g *G) Push(x int, y int) { fmt.Println(x) }", {("Push", "method", 2)}, {("Println", 1)}),
    "java": ("class A {\n  public int run(int a) { return go(); }\n}", {("A", "class", None), ("run", "method", 1)}, {("go", 0)}),
    "kotlin": ("class A {\n fun f(x: Int) = g(x)\n}", {("A", "class", None), ("f", "method", 1)}, {("g", 1)}),
    "cpp": ("namespace n {\nclass A {\n int r;\n};\n}\nint A::stop(int a, int b) { return f(a); }", {("n", "namespace", None), ("A", "class", None), ("stop", "method", 2)}, {("f", 1)}),
    "python": ("class A:\n  def f(self, a): return self.g(a)\n", {("A", "class", None), ("f", "method", 1)}, {("g", 1)}),
    "vue": ("<template><B/></template>\n<script>\nfunction f(a) { g(a) }\n</script>", {("f", "function", 1), ("default", "component", None)}, {("g", 1)}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_parsers(language):
    source, symbols, calls = SOURCES[language]
    got = parse.parse_text(source, language)
    assert {(s["name"], s["kind"], s["param_count"]) for s in got["symbols"]} == symbols
    assert {(r["name"], r["arg_count"]) for r in got["refs"] if r["ref_kind"] == "call"} == calls and got["parse_ok"]


def test_parser_offsets_are_bytes():
    got = parse.parse_text("# é\ndef f(): pass\n", "python")
    assert got["symbols"][0]["start_byte"] == len("# é\n".encode())
    assert parse.parse_text("def (", "python")["parse_ok"] is False and parse.parse_text(None, "rust")["symbols"] == []


def test_use_trees():
    assert list(parse.flattened("a::{b, c::{self, d as e}, *}")) == [("a::b", None), ("a::c", None), ("a::c::d", "e"), ("a::*", None)]


def test_ids_follow_files(spark):
    rows = spark.createDataFrame([("b", 0, None), ("b", 1, 0), ("a", 0, None)], "path string, at int, parent int")
    got = ingest.with_ids(rows, ["at"], "parent").collect()
    ids = {(r["path"], r["at"]): (r["id"], r["parent_id"]) for r in got}
    assert ids["b", 1][1] == ids["b", 0][0] and sorted(i for i, _ in ids.values()) == [1, 2, 3]


def test_innermost_is_narrowest(spark):
    spans = spark.createDataFrame([(1, 1, 0, 100), (2, 1, 10, 20), (3, 1, 10, 20), (4, 1, 12, 12)], "span_id long, file_id long, start long, end long")
    points = spark.createDataFrame([(1, 1, 15), (2, 1, 20), (3, 1, 100), (4, 2, 1)], "point_id long, file_id long, position long")
    assert {r["point_id"]: r["span_id"] for r in intervals.innermost(points, spans, bucket=7).collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_import_candidates(spark):
    df = spark.createDataFrame([("src/a/b.ts", "../c", "a/b.py", ".m.n")], "i string, s string, p string, q string")
    r = df.select(intervals.script_candidates(F.col("i"), F.col("s")), intervals.python_candidates(F.col("p"), F.col("q"))).first()
    assert r[0][:2] == ["src/c", "src/c.ts"] and r[1] == ["a/m/n.py", "a/m/n/__init__.py"]


def test_query_modes():
    assert search.mode_of("a b") == "hybrid" and search.mode_of("a b", lexical_options=True) == "lexical" and search.mode_of("a", "semantic") == "semantic"
    assert search.identifiers("parse_it() uses `Foo` and `foo`") == ["parse_it", "Foo"]


def test_sync_stream(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, content string, deleted boolean, at string").selectExpr("path", "content", "deleted", "cast(at as timestamp) at")
    incoming, store, marks = (f"file://{tmp_path}/{n}" for n in ("in", "store", "marks"))
    rows(("a", "1", False, "2024-01-01"), ("b", "1", False, "2024-01-01")).coalesce(1).write.parquet(f"{incoming}/x=1")
    sync.sync_stream(spark, f"{incoming}/*", store, marks).awaitTermination(120)
    rows(("a", "2", False, "2024-01-02"), ("a", "3", False, "2024-01-03"), ("b", None, True, "2024-01-02")).coalesce(1).write.parquet(f"{incoming}/x=2")
    sync.sync_stream(spark, f"{incoming}/*", store, marks).awaitTermination(120)
    assert [(r["path"], r["content"]) for r in sync.current(spark, store).collect()] == [("a", "3")]
    sync.compact(spark, store)
    assert [(r["path"], r["content"]) for r in sync.current(spark, store).collect()] == [("a", "3")]
