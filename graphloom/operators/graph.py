"""Graph assembly and ranking over nodes (id, label, path, kind, exported) and edges (source, target, kind, confidence, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import parent

RELATIONS = ("imports", "calls", "references")
STRUCTURAL = ("file", "dir", "external")
# Method names too common to be hubs.
TRIVIAL_HUBS = """as_str as_ref as_mut new default fmt from into clone eq hash drop len is_empty get set iter next
to_string text line push pop name""".split()
HUB_DEGREE, MOST_HUBS = 3, 10


# Identities.


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def dir_id(path: Column) -> Column:
    return F.concat(F.lit("dir:"), path)


def external_id(label: Column) -> Column:
    return F.concat(F.lit("ext:"), label)


def symbol_id(path: Column, name: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("#"), name, F.lit("@"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), kind)


# Assembly.


def assemble_nodes(files: DataFrame, symbols: DataFrame, scope: str = "symbol") -> DataFrame:
    """File nodes (config languages have none) and, unless the scope is files, symbol nodes."""
    code = files.where(F.col("language") != "toml")
    nodes = code.select(file_id(F.col("path")).alias("id"), F.substring_index("path", "/", -1).alias("label"), "path", F.lit("file").alias("kind"), F.lit(False).alias("exported"))
    if scope == "file":
        return nodes
    own = symbols.join(code.select("path"), "path", "left_semi")
    ident = symbol_id(F.col("path"), F.col("name"), F.col("start_byte"), F.col("end_byte"), F.col("kind"))
    return nodes.unionByName(own.select(ident.alias("id"), F.col("name").alias("label"), "path", "kind", F.col("is_exported").alias("exported")))


def contains_edges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children: id, parent (may be null or unknown), file; parents: id. Children without a known parent hang on their file."""
    known = parents.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    joined = children.join(known, "parent", "left")
    source = F.when(F.col("known"), F.col("parent")).otherwise(F.col("file"))
    return joined.select(source.alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))


def aggregated(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind): the largest confidence, and the smallest line among its edges."""
    best = F.max(F.struct(F.col("confidence"), (-F.col("line")).alias("m")))
    return edges.groupBy("source", "target", "kind").agg(best.alias("b"), F.count(F.lit(1)).alias("parallel")).select("source", "target", "kind", F.col("b.confidence").alias("confidence"), (-F.col("b.m")).alias("line"), "parallel")


def degree(edges: DataFrame, kinds_out: tuple[str, ...] = ("contains",)) -> DataFrame:
    """id, degree. Both ends count; they are counted before they meet."""
    use = edges.where(~F.col("kind").isin(*kinds_out)) if kinds_out else edges
    return use.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, most: int = MOST_HUBS) -> DataFrame:
    trivial = (F.col("kind") == "method") & F.col("label").isin(TRIVIAL_HUBS)
    ranked = nodes.join(degree(edges, ()).where(F.col("degree") >= HUB_DEGREE), "id").where((F.col("kind") != "directory") & ~trivial)
    return ranked.orderBy(F.desc("degree"), "label", "id").limit(most).select("id", "label", "kind", "path", "degree")


def collapsed(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """File-level edges: ends become their files (owner: id, file), self and contains edges go, the most confident stays."""
    a = owner.select(F.col("id").alias("source"), F.col("file").alias("f"))
    b = owner.select(F.col("id").alias("target"), F.col("file").alias("g"))
    moved = edges.where(F.col("kind") != "contains").join(a, "source", "left").join(b, "target", "left")
    moved = moved.select(F.coalesce("f", "source").alias("source"), F.coalesce("g", "target").alias("target"), "kind", "confidence", "line").where("source <> target")
    return aggregated(moved).drop("parallel")


def pruned_externals(nodes: DataFrame, edges: DataFrame, include: bool) -> tuple[DataFrame, DataFrame]:
    """Without externals, or with those that an edge still names."""
    if not include:
        gone = nodes.where("kind = 'external'").select(F.col("id").alias("target"))
        return nodes.where("kind <> 'external'"), edges.join(gone, "target", "left_anti")
    used = edges.select(F.col("target").alias("id")).distinct()
    kept = nodes.where("kind <> 'external'").unionByName(nodes.where("kind = 'external'").join(used, "id", "left_semi"))
    return kept, edges


def capped(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most `most` nodes, and the edges between what is left: structural nodes stay, symbols of least degree go first (of
    equals those whose ids sort first); 0 is no cap."""
    if not most:
        return nodes, edges
    structural = nodes.where(F.col("kind").isin(*STRUCTURAL))
    room = F.broadcast(structural.agg((F.greatest(F.lit(0), F.lit(most) - F.count(F.lit(1)))).alias("room")))
    symbols = nodes.where(~F.col("kind").isin(*STRUCTURAL)).join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    first = symbols.orderBy(F.desc("degree"), F.desc("id")).limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), F.desc("id"))))
    kept = first.join(room, F.col("place") <= F.col("room")).select(*nodes.columns)
    gone = nodes.where(~F.col("kind").isin(*STRUCTURAL)).select("id").join(kept.select("id"), "id", "left_anti")
    links = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti").select(edges.columns)
    return structural.unionByName(kept), links


def rolled_up(paths: DataFrame, path: str = "path") -> DataFrame:
    """Directory nodes and contains edges of all ancestors: source, target."""
    parts = F.split(path, "/")
    steps = paths.select(F.col(path).alias("path"), parts.alias("parts")).distinct()
    steps = steps.select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    prefix = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    steps = steps.where("n > 1").select(dir_id(prefix(F.col("n") - 1)).alias("source"), F.when(F.col("n") == F.size("parts"), file_id(F.col("path"))).otherwise(dir_id(prefix(F.col("n")))).alias("target"))
    return steps.distinct()


def file_links(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Undirected weighted links of files: low, high, weight."""
    a = owner.select(F.col("id").alias("source"), F.col("file").alias("f"))
    b = owner.select(F.col("id").alias("target"), F.col("file").alias("g"))
    ends = edges.where(F.col("kind").isin(*RELATIONS)).join(a, "source").join(b, "target").where("f <> g")
    return ends.groupBy(F.least("f", "g").alias("low"), F.greatest("f", "g").alias("high")).agg(F.count(F.lit(1)).alias("weight"))


def community_links(links: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """internal and external weight of each community, and weights between communities. member: id, community."""
    a = member.select(F.col("id").alias("low"), F.col("community").alias("ca"))
    b = member.select(F.col("id").alias("high"), F.col("community").alias("cb"))
    both = links.join(a, "low").join(b, "high").groupBy(F.least("ca", "cb").alias("one"), F.greatest("ca", "cb").alias("two")).agg(F.sum("weight").alias("weight"))
    inside = both.where("one = two").select(F.col("one").alias("community"), F.col("weight").alias("internal"), F.lit(0).cast("long").alias("external"))
    cross = both.where("one <> two")
    out = cross.select(F.explode(F.array("one", "two")).alias("community"), F.lit(0).cast("long").alias("internal"), F.col("weight").alias("external"))
    return inside.unionByName(out).groupBy("community").agg(F.sum("internal").alias("internal"), F.sum("external").alias("external")), cross


def bridges(links: DataFrame, member: DataFrame, most: int = 5) -> DataFrame:
    """Files that touch other communities: those of most communities, then of most links."""
    a = member.select(F.col("id").alias("low"), F.col("community").alias("ca"))
    b = member.select(F.col("id").alias("high"), F.col("community").alias("cb"))
    cross = links.join(a, "low").join(b, "high").where("ca <> cb")
    ends = cross.select(F.explode(F.array(F.struct(F.col("low").alias("id"), F.col("cb").alias("other"), "weight"), F.struct(F.col("high").alias("id"), F.col("ca").alias("other"), "weight"))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.count_distinct("other").alias("communities"), F.sum("weight").alias("links")).orderBy(F.desc("communities"), F.desc("links"), "id").limit(most)


def resolution_summary(refs: DataFrame, min_confidence: float) -> DataFrame:
    """One row of counts over refs (local_only, is_external, confidence or null, ambiguous); the cut counts before it drops."""
    found = F.col("confidence").isNotNull() & ~F.col("local_only")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return refs.agg(
        n(~F.col("local_only")).alias("eligible"),
        n(found).alias("resolved"),
        n(found & F.col("ambiguous")).alias("ambiguous"),
        n(~F.col("local_only") & F.col("confidence").isNull() & ~F.col("is_external")).alias("unresolved"),
        n(F.col("local_only")).alias("local_only"),
        n(~F.col("local_only") & F.col("is_external")).alias("external"),
        n(found & (F.col("confidence") < min_confidence)).alias("below_min_confidence"),
    )


def adjacency(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """node, neighbour, direction (out or in) for edges of the given kinds."""
    use = edges.where(F.col("kind").isin(kinds))
    return use.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit("out").alias("direction")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit("in").alias("direction")))).alias("x")).select("x.*")


def member_types(edges: DataFrame, member: DataFrame) -> DataFrame:
    """An owner type depends on what its members depend on. member: id, owner."""
    own = edges.where("kind = 'references'").join(member.select(F.col("id").alias("source"), "owner"), "source")
    return own.where("owner <> target").select(F.col("owner").alias("source"), "target", "kind", "confidence", "line")


def with_dirs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = nodes.where("kind = 'file'")
    up = rolled_up(files)
    ids = up.select(F.col("source").alias("id")).distinct()
    path = F.expr("substring(id, 5)")
    dirs = ids.select("id", F.substring_index(path, "/", -1).alias("label"), path.alias("path"), F.lit("dir").alias("kind"), F.lit(False).alias("exported"))
    more = up.select("source", "target", F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("line"))
    return nodes.unionByName(dirs), edges.unionByName(more)


def outline(symbols: DataFrame, public_only: bool = True) -> DataFrame:
    """Digest: directory, file, and its declarations by kind group."""
    rows = symbols.where("is_exported") if public_only else symbols
    group = F.when(F.col("kind").isin("class", "struct", "interface", "trait", "enum", "union", "object", "record"), "types").when(F.col("kind").isin("function", "method", "constructor"), "functions").otherwise("other")
    return rows.groupBy(parent(F.col("path")).alias("directory"), "path", group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
