"""From parsed files to the graph: import targets, references with what is known about them, and edges.

parsed: path, language, symbols, imports, refs, scopes, bindings (nested, as plans.parse.parsed() gives them). What needs only
one file is taken from its row; names meet other files by joins on paths and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import family_of, parent
from graphloom.operators import graph, intervals, resolve
from graphloom.operators.storage import checkpointed
from graphloom.plans.parse import FILE_MODULES

CALL_KINDS = {"call": "calls"}


def module_prefix(path: Column, language: Column) -> Column:
    """The module that a file's names belong to, where a file is one."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.when(language.isin(*sorted(FILE_MODULES)), F.concat(F.replace(stem, F.lit("/"), F.lit("::")), F.lit("::"))).otherwise("")


def symbol_table(parsed: DataFrame) -> DataFrame:
    """Symbols with their node ids, as resolve.py wants them."""
    each = parsed.select("path", "language", F.col("symbols").alias("all"), F.posexplode("symbols").alias("ordinal", "x"))
    ident = lambda x: graph.symbol_id(F.col("path"), x["name"], x["start_byte"], x["end_byte"], x["kind"])
    above = F.get("all", F.col("x.parent"))
    return each.select(
        ident(F.col("x")).alias("symbol_id"), "path", "ordinal", F.col("x.name").alias("name"), F.concat(module_prefix(F.col("path"), F.col("language")), F.replace("x.qualified", F.lit("."), F.lit("::"))).alias("qualified"), F.col("x.kind").alias("kind"), F.col("x.owner").alias("owner"),
        parent(F.col("path")).alias("package"), family_of(F.col("language")).alias("family"), F.col("x.is_exported").alias("exported"), F.col("x.param_count").alias("params"), "x.start_byte", "x.start_line",
        F.when(F.col("x.parent").isNotNull(), ident(above)).alias("parent"),
    )


def import_targets(parsed: DataFrame) -> DataFrame:
    """path, ordinal, alias, imported_name, line and target: the file that each import names, null for one outside."""
    each = parsed.select("path", family_of(F.col("language")).alias("family"), F.posexplode("imports").alias("ordinal", "x")).select("path", "family", "ordinal", "x.*")
    at = each.withColumn("import_id", F.concat("path", F.lit("#"), F.col("ordinal").cast("string")))
    found = intervals.first_existing(at.withColumnRenamed("path", "importer"), intervals.import_candidates(F.col("family"), F.col("importer"), F.col("specifier"), F.col("imported_name")), parsed.select("path"))
    return at.join(found.select("import_id", F.col("path").alias("target")), "import_id", "left").drop("import_id")


def _imported(imports: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a name of a file is bound to by its imports: symbols (path, name, import_targets) and files (path, receiver, namespaces)."""
    top = symbols.where("parent IS NULL").select(F.col("path").alias("target"), F.col("name").alias("imported_name"), "symbol_id")
    named = imports.where("alias IS NOT NULL AND imported_name IS NOT NULL AND target IS NOT NULL").join(top, ["target", "imported_name"])
    bound = named.groupBy("path", F.col("alias").alias("name")).agg(F.array_sort(F.collect_set("symbol_id")).alias("import_targets"))
    # A name that no symbol of the file has, or none at all, stands for the file.
    spaces = imports.where("alias IS NOT NULL AND target IS NOT NULL").join(named.select("path", "ordinal").distinct(), ["path", "ordinal"], "left_anti")
    return bound, spaces.groupBy("path", F.col("alias").alias("head")).agg(F.array_sort(F.collect_set("target")).alias("namespaces"))


def reference_table(parsed: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """References as resolve.resolved() wants them, with source (the enclosing symbol's node, else the file's) and line."""
    each = parsed.select("path", "language", "symbols", F.posexplode("refs").alias("ordinal", "x"))
    inside, ident = F.get("symbols", F.col("x.from_symbol")), lambda s: graph.symbol_id(F.col("path"), s["name"], s["start_byte"], s["end_byte"], s["kind"])
    # A method's owner is a type; anything else that holds a declaration gives no receiver.
    owner = inside["owner"]
    refs = each.select(
        F.concat("path", F.lit("#"), F.col("ordinal").cast("string")).alias("ref_id"), F.col("path").alias("file"), "language", family_of(F.col("language")).alias("family"), F.col("x.name").alias("name"), F.col("x.ref_kind").alias("ref_kind"),
        F.col("x.receiver").alias("receiver"), F.col("x.receiver_kind").alias("receiver_kind"), F.col("x.arg_count").alias("arg_count"), F.col("x.local_only").alias("local_only"), F.col("x.start_byte").alias("at"), F.col("x.line").alias("line"),
        F.when(F.col("x.receiver_kind") == "self", owner).alias("receiver_type"), owner.alias("owner"), parent(F.col("path")).alias("package"),
        F.when(F.col("x.scope_symbol").isNotNull(), ident(F.get("symbols", F.col("x.scope_symbol")))).alias("scope_target"), F.coalesce(F.when(F.col("x.from_symbol").isNotNull(), ident(inside)), graph.file_id(F.col("path"))).alias("source"),
        F.regexp_extract("x.receiver", r"^([^.:]*)", 1).alias("head"),
    )
    bound, spaces = _imported(imports, symbols)
    reach = imports.where("target IS NOT NULL").groupBy(F.col("path").alias("file")).agg(F.array_sort(F.collect_set("target")).alias("reachable"))
    refs = refs.join(bound.withColumnRenamed("path", "file"), ["file", "name"], "left").join(spaces.withColumnRenamed("path", "file"), ["file", "head"], "left").join(reach, "file", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    return refs.select(*[c for c in refs.columns if c not in ("import_targets", "namespaces", "reachable", "head")], *map(empty, ("import_targets", "namespaces", "reachable")), F.array().cast("array<string>").alias("receiver_bases"), none("string", "precise_status"), none("string", "precise_target"), none("double", "precise_confidence"))


def reference_edges(refs: DataFrame, resolved: DataFrame, symbols: DataFrame, files_only: bool = False, least: float = 0.0) -> DataFrame:
    """source, target, kind, confidence, line, evidence: resolved references between different nodes, one for each pair and kind (the
    most confident, then the first line). Below the least confidence there is no edge."""
    ends = symbols.select(F.col("symbol_id").alias("target"), F.col("path").alias("target_path"))
    kind = F.when(F.col("ref_kind") == "call", "calls").otherwise("references")
    hit = resolved.where(F.col("confidence") >= least).select("ref_id", "target", "confidence", "evidence").join(refs.select("ref_id", "file", "source", "line", kind.alias("kind")), "ref_id").join(ends, "target")
    if files_only:
        hit = hit.withColumns({"source": graph.file_id(F.col("file")), "target": graph.file_id(F.col("target_path"))})
    best = F.max(F.struct("confidence", (-F.col("line")).alias("m"), "evidence"))
    out = hit.where("source <> target").groupBy("source", "target", "kind").agg(best.alias("b"))
    return out.select("source", "target", "kind", "b.confidence", (-F.col("b.m")).alias("line"), "b.evidence")


def import_edges(imports: DataFrame, external: Column | None = None) -> DataFrame:
    """File to file, and to an external module (its label is the first part of the specifier) where no file is named."""
    label = F.regexp_extract("specifier", r"^([^.:/]+)", 1) if external is None else external
    target = F.coalesce(graph.file_id(F.col("target")), F.when(~F.col("is_relative") & (label != ""), graph.external_id(label)))
    each = imports.select(graph.file_id(F.col("path")).alias("source"), target.alias("target"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"), "line").where("target IS NOT NULL AND source <> target")
    return each.groupBy("source", "target", "kind", "confidence").agg(F.min("line").alias("line"))


def implements_edges(symbols: DataFrame) -> DataFrame:
    """`impl Trait for Type`: the type implements the trait, where each name is one symbol, or one of the block's own file."""
    blocks = symbols.where("kind = 'impl' AND name LIKE '% for %'").select("path", F.col("start_line").alias("line"), "symbol_id", F.trim(F.split("name", " for ")[0]).alias("trait"), F.trim(F.split("name", " for ")[1]).alias("type"))

    def pick(column: str, kinds: list[str], out: str) -> DataFrame:
        names = symbols.where(F.col("kind").isin(kinds)).select(F.col("name").alias("n"), F.col("symbol_id").alias("node"), F.col("path").alias("p"))
        found = blocks.select("symbol_id", "path", resolve.base_type(F.col(column)).alias("n")).join(names, "n").withColumn("own", F.col("p") == F.col("path"))
        each = found.groupBy("symbol_id").agg(F.collect_set("node").alias("all"), F.collect_set(F.when(F.col("own"), F.col("node"))).alias("own"))
        some = F.when((F.size("all") > 1) & (F.size("own") > 0), F.col("own")).otherwise(F.col("all"))
        return each.where(F.size(some) == 1).select("symbol_id", some[0].alias(out))

    both = blocks.join(pick("type", list({*resolve.TAGS, "class", "type"}), "source"), "symbol_id").join(pick("trait", list(resolve.DISPATCHED), "target"), "symbol_id")
    return both.where("source <> target").groupBy("source", "target").agg(F.min("line").alias("line")).select("source", "target", F.lit("implements").alias("kind"), F.lit(1.0).alias("confidence"), "line")


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, imports and references of parsed files, each written once: several joins read them."""
    parsed = checkpointed(parsed)
    symbols, imports = checkpointed(symbol_table(parsed)), checkpointed(import_targets(parsed))
    return symbols, imports, checkpointed(reference_table(parsed, symbols, imports))


def built(parsed: DataFrame, scope: str = "symbol", least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (contains, imports, calls, references, implements) of parsed files; the scope is symbol or file."""
    symbols, imports, refs = tables(parsed)
    files_only = scope == "file"
    found = reference_edges(refs, resolve.resolved(refs, symbols), symbols, files_only, least)
    edges = found.drop("evidence").unionByName(import_edges(imports))
    nodes = parsed.select("path").select(graph.file_id(F.col("path")).alias("id"), F.substring_index("path", "/", -1).alias("label"), "path", F.lit("file").alias("kind"), F.lit(False).alias("exported"))
    if not files_only:
        nodes = nodes.unionByName(symbols.select(F.col("symbol_id").alias("id"), F.col("name").alias("label"), "path", "kind", "exported"))
        held = symbols.select(F.coalesce("parent", graph.file_id(F.col("path"))).alias("source"), F.col("symbol_id").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), F.col("start_line").alias("line"))
        edges = edges.unionByName(held).unionByName(implements_edges(symbols))
    outside = edges.where(F.col("target").startswith("ext:")).select(F.col("target").alias("id")).distinct()
    nodes = nodes.unionByName(outside.select("id", F.expr("substring(id, 5)").alias("label"), F.lit(None).cast("string").alias("path"), F.lit("external").alias("kind"), F.lit(False).alias("exported")))
    return nodes, edges
