"""Query registry: each module pairs DataFrame functions with their DuckDB twins."""

from graphloom.queries import assembly, corpus, explaining, graphs, resolution, sources, upkeep

MODULES = (assembly, corpus, explaining, graphs, resolution, sources, upkeep)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
