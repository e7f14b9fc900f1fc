"""Registered queries against their SQL, and the registration itself."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from riskbook.compare import diff
from riskbook.llm.queries import ORACLE, QUERIES

from .helpers import SF

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def test_every_operator_is_registered():
    names = set(entry_mod.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert diff(df.columns, df.collect(), rel.columns, rel.fetchall()) is None
