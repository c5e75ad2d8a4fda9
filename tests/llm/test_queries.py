"""The registered queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from tallyloom.llm import queries

from ..test_queries import duck, rows

__all__ = ["duck"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, duck, name):  # noqa: F811
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()][:10] == [f"op{i}" for i in range(1, 11)]
    assert not any(n.startswith("op") for n in list(queries.queries())[10:])
