"""Queries of the subpackage and their DuckDB twins."""

from graphloom.llm import queries_chat, queries_dedup, queries_jaccard, queries_language, queries_nearest, queries_packing, queries_pieces, queries_quality, queries_toxicity, queries_urls

MODULES = (queries_urls, queries_chat, queries_pieces, queries_jaccard, queries_toxicity, queries_quality, queries_language, queries_nearest, queries_packing, queries_dedup)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
