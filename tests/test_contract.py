"""The driver contract: entry, queries and oracle SQL at sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from riskbook.compare import diff
from riskbook.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="test data not present")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 76      # red-flag borrowers at sf0.001 (FIXTURES.md section 3)
    assert df.columns == ["CustomerID", "CustomerName", "CustomerType", "TotalLoanDebt",
                          "TotalLiquidAssets", "DAR", "UncollateralizedDebt"]


def test_every_report_has_an_oracle():
    assert set(QUERIES) <= set(entry_mod.queries())
    assert set(QUERIES) <= set(entry_mod.oracle_sql())


# Spark type name -> DuckDB type name of the same values.
_DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF)
    rel = duck.sql(entry_mod.oracle_sql()[name])
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert _DUCK_TYPE.get(t, t.upper()) == types.get(f.name), f"{f.name}: {t} vs {types.get(f.name)}"
    problem = diff(df.columns, df.collect(), rel.columns, rel.fetchall())
    assert problem is None, problem


def test_a_failed_load_step_is_raised(spark, monkeypatch):
    from riskbook import registry
    from riskbook.plans.materialize import Store

    def broken(self, *args, **kwargs):
        raise OSError("shared folder not writable")

    monkeypatch.setattr(Store, "_save", broken)
    monkeypatch.setattr(registry, "_BOOKS", {})
    with pytest.raises(OSError, match="not writable"):
        entry_mod.queries()["red_flag_list"](spark, SF)
