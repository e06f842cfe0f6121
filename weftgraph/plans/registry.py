"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from weftgraph.plans import array_queries, data_queries, graph_queries, source_queries

QUERIES = {**graph_queries.QUERIES, **array_queries.QUERIES, **source_queries.QUERIES, **data_queries.QUERIES}
ORACLE_SQL = {**graph_queries.ORACLE_SQL, **array_queries.ORACLE_SQL, **source_queries.ORACLE_SQL, **data_queries.ORACLE_SQL}
FLAGSHIP = "pagerank_frontier"
