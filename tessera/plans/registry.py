"""All queries of the engine and their SQL statements."""

from tessera.plans import embed_queries, field_queries, marker_queries, queries

MODULES = (queries, field_queries, marker_queries, embed_queries)
QUERIES = queries.QUERIES
SQL = queries.SQL
