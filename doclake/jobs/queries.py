"""All registered queries of the document jobs, and their SQL."""

from __future__ import annotations

from doclake.jobs import content_queries, convert_queries, foreign_queries, markdown_queries, render_queries, resolve_queries, scalar_queries, table_queries

MODULES = (markdown_queries, scalar_queries, table_queries, resolve_queries, render_queries, convert_queries, foreign_queries, content_queries)


def queries():
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
