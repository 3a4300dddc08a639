"""From source texts to edges. The texts are written from the part table, twenty parts to a file, so that SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.operators import assemble, bm25, documents, intervals
from graphloom.operators.storage import dealt_out
from graphloom.plans import parse
from graphloom.queries.base import Registry, table

registry = Registry()
add = registry.add
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE

# A file for twenty parts: a class with a method for each part, a helper beside it and a function that the next file imports.
# Comments, strings and a shadowed name hold calls that are none.
METHOD = '''    def part_%1$d(self, given, helper_x):
        """Not a call: helper_%2$d(1)."""
        # nor this: base_%2$d(2)
        helper_x(given)
        return helper_%2$d(given) + self.size() + %3$s
'''


def module_files(spark, sf_dir):
    """path, language, text."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 20).alias("f"))
    least = p.agg(F.min("f").alias("first"))
    p = p.join(F.broadcast(least), F.lit(True))
    before = F.when(F.col("f") > F.col("first"), F.format_string("base_%d(given)", F.col("f") - 1)).otherwise(F.lit("0"))
    method = F.format_string(METHOD, "p_partkey", "f", before)
    rows = dealt_out(p, "f").groupBy("f", "first").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", method.alias("m")))).m, "").alias("body"))
    head = F.when(F.col("f") > F.col("first"), F.format_string("from .m%d import base_%d\nimport outside_%d.tools\n\n\n", F.col("f") - 1, F.col("f") - 1, F.col("f") % 3)).otherwise(F.lit(""))
    owner = F.format_string("class Owner%d:\n    def size(self):\n        return 1\n\n", "f")
    tail = F.format_string("\n\ndef helper_%1$d(x):\n    return x\n\n\ndef base_%1$d(x):\n    return helper_%1$d(x)\n", "f")
    return rows.select(F.format_string("pkg/m%d.py", "f").alias("path"), F.lit("python").alias("language"), F.concat(head, owner, "body", tail).alias("text"))


_P = "WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS f, (SELECT min(p_partkey // 20) FROM part) AS first FROM part)"


@add(_P + """ SELECT 'part_' || k AS source, 'helper_' || f AS target, 'calls' AS kind, 0.95::DOUBLE AS confidence, 'scope' AS evidence FROM p UNION ALL SELECT 'part_' || k, 'size', 'calls', 0.85, 'receiver' FROM p
UNION ALL SELECT 'part_' || k, 'base_' || (f - 1), 'calls', 0.9, 'import' FROM p WHERE f > first UNION ALL SELECT DISTINCT 'base_' || f, 'helper_' || f, 'calls', 0.95, 'scope' FROM p""")
def call_edges(spark, sf_dir):
    """Source texts, parsed, resolved and joined to edges between symbols."""
    symbols, _, refs = assemble.tables(parse.parsed(module_files(spark, sf_dir)))
    edges = assemble.reference_edges(refs, assemble.resolve.resolved(refs, symbols), symbols)
    name = lambda c: F.regexp_extract(c, "#([^@]*)@", 1).alias(c)
    return edges.select(name("source"), name("target"), "kind", "confidence", "evidence")


@add(_P + """, c AS (SELECT count(*) AS k, count(DISTINCT f) AS f, count(DISTINCT f) FILTER (f > first) AS n, count(*) FILTER (f > first) AS m, count(DISTINCT f % 3) FILTER (f > first) AS x FROM p)
SELECT 'calls' AS kind, 2 * k + m + f AS edges FROM c UNION ALL SELECT 'contains', k + 4 * f FROM c UNION ALL SELECT 'imports', 2 * n FROM c""")
def graph_totals(spark, sf_dir):
    """Edges by kind of the graph that the same source texts give."""
    _, edges = assemble.built(parse.parsed(module_files(spark, sf_dir)))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@add(_P + """ SELECT 'file:pkg/m' || f || '.py' AS source, 'file:pkg/m' || (f - 1) || '.py' AS target, 'calls' AS kind, 0.9::DOUBLE AS confidence FROM p WHERE f > first GROUP BY f
UNION ALL SELECT 'file:pkg/m' || f || '.py', 'file:pkg/m' || (f - 1) || '.py', 'imports', 1.0 FROM p WHERE f > first GROUP BY f UNION ALL SELECT 'file:pkg/m' || f || '.py', 'ext:outside_' || (f % 3), 'imports', 1.0 FROM p WHERE f > first GROUP BY f""")
def file_graph(spark, sf_dir):
    """The same graph in the scope of files."""
    return assemble.built(parse.parsed(module_files(spark, sf_dir)), "file")[1].select("source", "target", "kind", "confidence")


@add("""SELECT 'T' || s_suppkey AS source, 'Shape' || (s_suppkey % 10) AS target, 'implements' AS kind FROM supplier""")
def implements_edges(spark, sf_dir):
    """Rust blocks `impl Trait for Type`: each type is declared beside its block, and traits have a file of their own."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    block = F.format_string("pub struct T%1$d { n: u32 }\nimpl Shape%2$d for T%1$d {\n    fn area(&self) -> u32 { self.n }\n}\n", "s_suppkey", F.col("s_suppkey") % 10)
    types = s.select(F.format_string("src/t%d.rs", "s_suppkey").alias("path"), F.lit("rust").alias("language"), block.alias("text"))
    traits = spark.range(10).agg(F.array_join(F.collect_list(F.format_string("pub trait Shape%d { fn area(&self) -> u32; }", "id")), "\n").alias("text")).select(F.lit("src/shapes.rs").alias("path"), F.lit("rust").alias("language"), "text")
    symbols = assemble.symbol_table(parse.parsed(types.unionByName(traits)))
    name = lambda c: F.regexp_extract(c, "#([^@]*)@", 1).alias(c)
    return assemble.implements_edges(symbols).select(name("source"), name("target"), "kind")


@add("""WITH p AS (SELECT p_partkey AS k, p_partkey // 8 AS j, p_partkey % 4 AS l FROM part),
t AS (SELECT k, l, j, CASE l WHEN 0 THEN CASE WHEN j % 2 = 0 THEN 'pkg/k' || j || '.py' WHEN j % 3 = 0 THEN 'pkg/k' || j || '/__init__.py' END
 WHEN 1 THEN CASE WHEN j % 2 = 0 THEN 'src/k' || j || '.rs' WHEN j % 3 = 0 THEN 'src/k' || j || '/mod.rs' END WHEN 2 THEN CASE WHEN j % 2 = 0 THEN 'web/k' || j || '.tsx' WHEN j % 3 = 0 THEN 'web/k' || j || '/index.vue' END
 ELSE CASE WHEN j % 2 = 0 THEN 'src/main/java/com/K' || j || '.java' WHEN j % 3 = 0 THEN 'src/commonMain/kotlin/com/K' || j || '.kt' END END AS path FROM p)
SELECT k AS import_id, path FROM t WHERE path IS NOT NULL""")
def import_rules(spark, sf_dir):
    """Imports of four languages against files that exist for some of their modules."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 8).alias("j"), (F.col("p_partkey") % 4).alias("l"))
    made = lambda pattern: F.format_string(pattern, "j")
    pick = lambda *each: F.when(F.col("l") == 0, each[0]).when(F.col("l") == 1, each[1]).when(F.col("l") == 2, each[2]).otherwise(each[3])
    lit = lambda *x: pick(*map(F.lit, x))
    imports = p.select(F.col("k").alias("import_id"), lit("python", "rust", "typescript", "java").alias("family"), lit("pkg/sub/m.py", "src/deep/m.rs", "web/a/b.ts", "src/main/java/Main.java").alias("importer"), pick(made("..k%d"), made("crate::k%d"), made("../k%d"), made("com.K%d.make")).alias("specifier"), lit("name", "Item", "default", "make").alias("name"))
    even = pick(made("pkg/k%d.py"), made("src/k%d.rs"), made("web/k%d.tsx"), made("src/main/java/com/K%d.java"))
    third = pick(made("pkg/k%d/__init__.py"), made("src/k%d/mod.rs"), made("web/k%d/index.vue"), made("src/commonMain/kotlin/com/K%d.kt"))
    files = p.select(F.when(F.col("j") % 2 == 0, even).when(F.col("j") % 3 == 0, third).alias("path")).where("path IS NOT NULL").distinct()
    found = intervals.import_candidates(F.col("family"), F.col("importer"), F.col("specifier"), F.col("name"))
    return intervals.first_existing(imports, found, files)


@add(_P + """, d AS (SELECT f, k, 'part_' || k AS name, 'method' AS kind FROM p UNION ALL SELECT DISTINCT f, NULL, n || f, CASE n WHEN 'Owner' THEN 'class' ELSE 'function' END FROM p, (SELECT unnest(['Owner', 'helper_', 'base_']) AS n)
UNION ALL SELECT DISTINCT f, NULL, 'size', 'method' FROM p UNION ALL SELECT DISTINCT f, NULL, 'm' || f || '.py', 'file' FROM p WHERE f > first) SELECT 'pkg/m' || f || '.py' AS path, name, kind FROM d""")
def symbol_documents(spark, sf_dir):
    """Search documents of the same source texts: symbols, and the imports before them."""
    files = module_files(spark, sf_dir)
    return documents.search_documents(parse.parsed(files), files, terms(F.col("text"))).select("path", "name", "kind")


@add(_P + """, n AS (SELECT count(*) AS methods, count(DISTINCT f) AS files FROM p) SELECT 'given' AS term, methods + files AS documents FROM n UNION ALL SELECT 'size', methods + 2 * files FROM n UNION ALL SELECT 'outside', count(DISTINCT f) FROM p WHERE f > first""")
def symbol_postings(spark, sf_dir):
    """How many symbol documents hold some terms of the index."""
    files = module_files(spark, sf_dir)
    docs = documents.search_documents(parse.parsed(files), files, terms(F.col("text")))
    posts = bm25.postings(docs, documents.indexed_text(), "key").where(F.col("term").isin("given", "size", "outside"))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@add(_P + " SELECT 'pkg/m' || f || '.py' AS path, 'Owner' || f AS name, 1 + count(*) AS bodies, false AS holds_code FROM p GROUP BY f")
def container_summaries(spark, sf_dir):
    """Classes of the same source texts without the bodies of their methods."""
    files = module_files(spark, sf_dir)
    got = documents.container_summaries(parse.parsed(files), files)
    bodies = (F.length("text") - F.length(F.replace("text", F.lit(documents.MARK), F.lit("")))) / len(documents.MARK)
    return got.select("path", "name", bodies.cast("long").alias("bodies"), F.col("text").contains("return").alias("holds_code"))
