"""All checked queries.  Importing the modules registers them."""

from orderlens.catalog import analytics, ingest, modelling, orders, text, triage  # noqa: F401
from orderlens.catalog.core import QUERIES, SQL, complete_sql
from orderlens.catalog.relations import RELATIONS


def all_queries():
    return dict(QUERIES)


def all_sql():
    return {name: complete_sql(sql, RELATIONS) for name, sql in SQL.items()}
