"""Sinks: graphs as JSON lines, DOT and a self-contained page; bundles as Markdown."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A drawn graph is for eyes: more nodes or edges than this are refused rather than collected.
MOST_DRAWN = 20_000


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as JSON lines, written by the executors."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements of a DOT graph, one a row: `place` orders them, and text writers can store them as they are."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("place"), F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.col("label")), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("place"), F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [label="), quoted(F.col("kind")), F.lit("];")).alias("line"))
    return n.unionByName(e)


def _drawn(df: DataFrame) -> list:
    rows = df.limit(MOST_DRAWN + 1).collect()
    if len(rows) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} rows to draw: focus or cap the graph first")
    return rows


def dot(nodes: DataFrame, edges: DataFrame) -> str:
    rows = _drawn(dot_lines(nodes, edges).orderBy("place", "line"))
    return "digraph code {\n" + "\n".join(r["line"] for r in rows) + "\n}\n"


def page(nodes: DataFrame, edges: DataFrame, title: str = "graph") -> str:
    """A page that holds its data and lists what it draws; it loads nothing."""
    data = {"nodes": [r.asDict() for r in _drawn(nodes.orderBy("id"))], "edges": [r.asDict() for r in _drawn(edges.orderBy("source", "target", "kind"))]}
    safe = json.dumps(data).replace("</", "<\\/")
    rows = "".join(f"<li>{html.escape(e['source'])} &rarr; {html.escape(e['target'])} ({html.escape(e['kind'])})</li>" for e in data["edges"])
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{rows}</ul><script type="application/json" id="data">{safe}</script></body></html>'


def write_bundle(sections: DataFrame, path: str) -> None:
    """Markdown sections (path, section) as text files, in order of their paths."""
    sections.orderBy("path").select("section").write.mode("overwrite").text(path)
