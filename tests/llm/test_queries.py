"""Corpus queries against DuckDB where SQL can say them, and the registered names."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from marktrace.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    ok, _, note = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
