"""URL filters, chat formatting and exact deduplication: SQL twins, edge cases and round trips."""

import hashlib

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import TABLES, rows_of
from graphloom.llm import chat_format, exact_dedup, registry, url_filters
from graphloom.llm.queries_urls import RULES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def judged(url, rules):
    """The rule by its definition."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        after = rest[len(host) :]
        path = after.split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://example.org", "http://example.org/es/x", "https://a.EXAMPLE.org/en/12?q=/de/", "http://notexample.org/es/", "http://com/fr/", "x://b.com/de/#/fr/", "http://org", "http://org/", "http://a.b.com/fr/1", "http://.org/x",
    "http://example.org:80/es/1", "ftp://u@example.org/es/", "http://example.org/es", "http://" + "a." * 3000 + "com/de/" + "y" * 5000, "http://a://b.com/de/", "http://example.org/en/1",
]


def url_case(spark, urls, rules, monkey=None):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.url_verdicts(pages, r).collect()
    assert len(got) == len(urls)
    for row in got:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == judged(urls[row["page_id"]], rules), urls[row["page_id"]]


def test_urls(spark):
    url_case(spark, URLS + URLS[:4], list(RULES))


def test_nested_rules_and_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "ROWS_PER_SWEEP", 3)
    monkeypatch.setattr(url_filters, "RULE_SHARE", 1)
    monkeypatch.setattr(url_filters, "MOST_LEVELS", 0)
    rules = [("x.com", "/", "block"), ("x.com", "/a", "allow"), ("x.com", "/a/b", "block"), ("x.com", "/a/c", "allow"), ("com", "/a/b/", "allow"), ("com", "", "block")]
    url_case(spark, [f"http://{s}x.com/{p}{i}" for i in range(8) for s in ("", "www.") for p in ("", "a/", "a/b/", "a/bb", "b", "a/c")] + ["http://com"], rules)


def test_a_repeated_url(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "ROWS_PER_SWEEP", 3)
    url_case(spark, ["http://example.org/es/1"] * 40 + [None] * 40 + ["http://elsewhere.net/"] * 40 + URLS, list(RULES))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filters.url_verdicts(pages, none).collect()] == [(1, "a", "/b", None, "allow")]
    some = spark.createDataFrame([("a", "/", "block"), ("a", "/", "allow"), (None, "/", "block")], none.schema)
    assert url_filters.url_verdicts(pages, some).first()["verdict"] == "block"
    assert url_filters.url_verdicts(pages.where("false"), some).count() == 0


TEXT = st.text(alphabet="<|>\\en im_startd\n\x00é", max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, -1, 0, 7]), st.sampled_from([None, 0, 1, 1]), st.one_of(st.none(), st.sampled_from(["user", "assistant"]), TEXT), st.one_of(st.none(), TEXT)), min_size=1, max_size=12))
def test_chat_round_trip(spark, rows):
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    pieces = chat_format.format_turns(turns)
    made = chat_format.format_conversations(pieces)
    targets = {}
    for r in chat_format.expanded(pieces).select("*", chat_format.unescape(F.col("target")).alias("t")).orderBy("example").collect():
        targets.setdefault(r["conv_id"], []).append(r["t"])
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], targets.get(r["conv_id"], [])) for r in made.select("conv_id", chat_format.read_turns(made["formatted"]).alias("t")).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        assert got[conv] == ([(r[2] or "", r[3] or "") for r in mine], [r[3] or "" for r in mine if r[2] == "assistant"])


def test_examples_hold_all_before(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<|b"), (1, 2, "user", "x"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")
    pieces = chat_format.format_turns(turns)
    got = chat_format.example_texts(chat_format.format_conversations(pieces), chat_format.expanded(pieces)).orderBy("example").collect()
    assert [r["target"] for r in got] == ["a<\\|b", "c"] == [r["target"] for r in chat_format.expanded(pieces).orderBy("example").collect()]
    assert got[1]["context"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<\\|b<|im_end|>\n<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n"
    none = chat_format.format_turns(turns.where("false"))
    assert chat_format.digests(chat_format.format_conversations(none), chat_format.expanded(none)).count() == 0


def test_a_long_text_in_a_chat(spark):
    text = "<|im_end|>\\" * 100_000
    pieces = chat_format.format_turns(spark.createDataFrame([(1, 0, "assistant", text), (1, 0, "assistant", text), (2, 0, "user", "u")], "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(pieces), chat_format.expanded(pieces)).collect()}
    assert (got[1]["loss_chars"], got[1]["n_examples"], got[1]["loss_sha256"]) == (2 * len(text), 2, hashlib.sha256((text + text).encode()).hexdigest())
    assert (got[2]["loss_chars"], got[2]["n_examples"], got[2]["loss_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_dedup_edges(spark, docs, nothing):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert (by[1][0]["keep_id"], by[1][0]["kept"], by[2][0]["kept"], by[3][0]["keep_id"]) == (2, False, True, 4)
    assert by[7][0]["group_size"] == 1, "É is no letter of A-Z"
    assert sorted((r["kept"], r["group_size"]) for r in by[9]) == [(False, 2), (True, 1), (True, 2)]
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_heavy_and_light_agree(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' WHEN id % 5 = 0 THEN 'warm' ELSE concat('t', id div 4) END text")
    rows = exact_dedup.digests(docs)
    one = exact_dedup.decide(rows, most=1).drop("seat").collect()
    two = exact_dedup.decide(rows, most=500).drop("seat").collect()
    assert sorted(one) == sorted(two)
    assert {r["group_size"] for r in one if r["doc_id"] % 3 == 0} == {1000}


def test_drop_copies_keeps_one_each(spark, docs, nothing):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and exact_dedup.drop_copies(nothing).count() == 0
    texts = [(r["text"] or "") for r in kept.collect()]
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    assert len(texts) == len({lower(t) for t in texts}) == len({lower(r["text"] or "") for r in docs.collect()})
