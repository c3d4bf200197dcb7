"""What the registry gives as SQL is SQL."""

from __future__ import annotations

import duckdb

from barline.llm import registry


def test_equivalents_are_sql():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    for name, sql in registry.ORACLE_SQL.items():
        assert isinstance(sql, str) and len(duckdb.extract_statements(sql)) == 1, name
