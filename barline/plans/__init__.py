"""Registered queries over the stored tables, each with its DuckDB equivalent where SQL can state it."""

from . import income, ledgers, macro, metrics, more, ranking, store, streams, studies, text

MODULES = [metrics, ranking, studies, store, income, ledgers, macro, text, streams, more]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
