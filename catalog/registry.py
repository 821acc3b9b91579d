"""All registered queries and their SQL."""

from catalog import match_queries, stream_queries, table_queries, text_queries

MODULES = [text_queries, table_queries, match_queries, stream_queries]
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
