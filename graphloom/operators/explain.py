"""Finding targets, visibility, risk, snippets, signatures, comments, reports and the final order of hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import module_root, parent
from graphloom.functions.text import lines, trimmed

#: Confidence up to which an edge makes what it reaches risky.
RISKY = 0.7
SIGNATURE_LINES = 5


def find_targets(nodes: DataFrame, query: str) -> DataFrame:
    """nodes (id, label, path, qualified) that a query names: by qualified name, label, id, id suffix, path or path suffix."""
    q = F.col("qualified")
    ok = (q == query) | (F.replace(q, F.lit("::"), F.lit(".")) == query) | (F.col("label") == query) | (F.col("id") == query) | F.col("id").endswith(f"::{query}") | (F.col("path") == query) | F.col("path").endswith(query)
    return nodes.where(F.coalesce(ok, F.lit(False)))


def risky(exported: Column, confidence: Column, community: Column, other_community: Column, path: Column, other_path: Column) -> Column:
    """Exported, reached by a doubtful edge, or across a module: another community, or without one another top directory."""
    known = community.isNotNull() & other_community.isNotNull()
    crosses = F.when(known, community != other_community).otherwise(module_root(path) != module_root(other_path))
    return F.coalesce(exported, F.lit(False)) | F.coalesce(confidence <= RISKY, F.lit(False)) | F.coalesce(crosses, F.lit(False))


def snippets(edges: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """edges (path, line) with the trimmed source line they come from; null for a blank line or none. Only the lines that edges
    name leave their file, one row for each."""
    wanted = edges.where("line > 0").groupBy("path").agg(F.collect_set(F.col("line").cast("int")).alias("wanted"))
    named = files.select("path", content).join(wanted, "path").select("path", lines(F.col(content)).alias("l"), "wanted")
    each = named.select("path", F.explode(F.transform("wanted", lambda n: F.struct(n.alias("line"), F.nullif(trimmed(F.try_element_at("l", n)), F.lit("")).alias("snippet")))).alias("x"))
    return edges.join(each.select("path", F.col("x.line").alias("line"), "x.snippet"), ["path", "line"], "left")


def signature(content: Column, start_line: Column) -> Column:
    """Source from a line on, up to 5 lines, cut before a body, a statement's end or a value; on one line."""
    part = F.array_join(F.slice(lines(content), start_line.cast("int"), SIGNATURE_LINES), "\n")
    return F.trim(F.regexp_replace(F.regexp_extract(part, r"^([^{;=]*)", 1), r"\s+", " "))


def doc_comment(content: Column, start_line: Column) -> Column:
    """The comment right above a line (///, //, /** */, #, with attributes and blank lines skipped), without its marks."""
    above = F.reverse(F.slice(lines(content), 1, F.greatest(start_line.cast("int") - 1, F.lit(0))))
    trimmed = F.transform(above, lambda l: F.trim(l))
    is_doc = lambda l: l.rlike(r"^(?://|/\*|\*|#(?!\[|\s*include))|\*/$")
    passed = lambda l: (l == "") | l.rlike(r"^(?:#\[|@)")
    # Blank lines and attributes come first, then comment lines; what follows the first other line is not looked at.
    state = lambda got, over: F.struct(got.alias("got"), over.alias("over"))

    def step(s: Column, l: Column) -> Column:
        take, stop = ~s["over"] & is_doc(l), s["over"] | (~is_doc(l) & (~passed(l) | (F.size(s["got"]) > 0)))
        return state(F.when(take, F.concat(F.array(l), s["got"])).otherwise(s["got"]), F.coalesce(stop, F.lit(True)))

    walk = F.aggregate(trimmed, state(F.array().cast("array<string>"), F.lit(False)), step)
    bare = F.transform(walk["got"], lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, r"\*/$", ""), r"^(?:///?!?|/\*\*?|\*|#)\s?", "")))
    return F.nullif(F.array_join(F.filter(bare, lambda l: l != ""), "\n"), F.lit(""))


def report(files: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row of totals: files, lines, languages, edges, ambiguous edges, communities."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages"), F.sum("size").alias("size"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("confidence") < 0.5).alias("doubtful"))
    m = member.agg(F.count_distinct("community").alias("communities"))
    return f.join(e, F.lit(True)).join(m, F.lit(True))


def subsystems(counts: DataFrame, most: int = 12) -> DataFrame:
    """Communities by size with their cohesion. counts: community, size, internal, external."""
    cohesion = F.round(F.try_divide(F.col("internal").cast("double"), F.col("internal") + F.col("external")), 2)
    return counts.withColumn("cohesion", cohesion).orderBy(F.desc("size"), "community").limit(most)


def final_order(hits: DataFrame, limit: int) -> DataFrame:
    """Exact identities first, then lexical hits, then relevance; ties by path, start and key."""
    return hits.orderBy(F.desc("exact"), F.desc("lexical"), F.desc_nulls_last("relevance"), "path", "start", "key").limit(limit)


def rarest_operations(operations: DataFrame, most: int = 16) -> DataFrame:
    """key, operation, position: each symbol's operations that fewest files use, in source order. operations: key, file, operation, position."""
    files = operations.groupBy("operation").agg(F.count_distinct("file").alias("files"))
    once = operations.groupBy("key", "operation").agg(F.min("position").alias("position"))
    order = Window.partitionBy("key").orderBy("files", "position", "operation")
    return once.join(files, "operation").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("key", "operation", "position")


def length_bucket(n: Column) -> Column:
    """Batches of inputs of like length: the least of 64, 128, 256, 384 and 512 that holds it."""
    return F.when(n <= 64, 64).when(n <= 128, 128).when(n <= 256, 256).when(n <= 384, 384).otherwise(512)


def hash_embedding(words: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(words, lambda w: at(w) == d), F.lit(0.0), lambda s, w: s + sign(w)))


def field_chain(starts: DataFrame, fields: DataFrame) -> DataFrame:
    """id, type of `a.b.c`: each hop looks the field up in the type reached so far. starts: id, type, hops (array); fields: owner, name, type.
    There are as many rounds as the longest chain has hops."""
    now = starts.select("id", "type", "hops")
    step = fields.select(F.col("owner").alias("o"), F.col("name").alias("f"), F.col("type").alias("t"))
    for _ in range(now.agg(F.max(F.size("hops"))).first()[0] or 0):
        hop = F.try_element_at("hops", F.lit(1))
        joined = now.join(step, (F.col("type") == F.col("o")) & (hop == F.col("f")), "left")
        now = joined.select("id", F.when(F.size("hops") > 0, F.col("t")).otherwise(F.col("type")).alias("type"), F.slice("hops", 2, 1 << 20).alias("hops"))
    return now.select("id", F.when(F.size("hops") == 0, F.col("type")).alias("type"))


def scope_bindings(uses: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """use_id, binding_id, kind: the binding of a name in the innermost scope that declares it before the use. More than one
    in that scope is no answer. uses: use_id, file_id, name, position; scopes: scope_id, file_id, start, end; bindings:
    binding_id, scope_id, name, kind, at."""
    inside = uses.join(scopes.select("scope_id", "file_id", F.col("start").alias("a"), F.col("end").alias("b")), "file_id").where("a <= position AND position < b")
    hit = inside.join(bindings.select("binding_id", "scope_id", "name", "kind", "at"), ["scope_id", "name"]).where("at <= position").withColumn("width", F.col("b") - F.col("a"))
    first = hit.withColumn("least", F.min("width").over(Window.partitionBy("use_id"))).where("width = least")
    return first.groupBy("use_id").agg(F.count(F.lit(1)).alias("n"), F.min("binding_id").alias("binding_id"), F.min("kind").alias("kind")).where("n = 1").drop("n")


def repaired_snapshots(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshots to write again: missing ones and those whose content does not match its hash. stored: path, content; files: path, content_hash."""
    ok = stored.where(F.col("content").isNotNull()).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return files.select("path", "content_hash").join(ok, ["path", "content_hash"], "left_anti")


def stale(meta: DataFrame, revision: str) -> bool:
    """Whether a store was written by another analyzer revision. meta: key, value, a handful of rows."""
    row = meta.where("key = 'analyzer_revision'").select("value").first()
    return row is None or row["value"] != revision


def include_specifiers(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*["<]([^">]+)[">]'), F.lit(1))


def query_words(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]{2,}", query.lower())))


def siblings(symbols: DataFrame) -> DataFrame:
    """Explain: members of each owner as one row: directory, owner, members in order of their lines."""
    return symbols.where("owner IS NOT NULL").groupBy(parent(F.col("path")).alias("directory"), "owner").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("m")).select("directory", "owner", F.col("m.name").alias("members"))
