"""All queries over the given tables, and the SQL that gives the same rows."""

from . import aggregate_queries, case_queries, feature_queries, graph_queries, ingest_queries, model_queries

_MODULES = [feature_queries, ingest_queries, aggregate_queries, graph_queries, case_queries, model_queries]
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
