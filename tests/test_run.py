"""End-to-end run: every report written, views registered and queryable."""

from __future__ import annotations

import tempfile

import pytest

from riskbook.registry import BOOK_QUERIES
from riskbook.run import find_tables, list_views, register_views, run_all
from riskbook.sources.book import Book

from .fixtures import random_tables, role_book


def test_run_all_and_views(spark):
    book = role_book(spark, random_tables(5))
    out = tempfile.mkdtemp(prefix="rb-out-")
    names = ["exposure_by_status", "red_flag_list", "credit_health_score", "integrity_summary"]
    written = run_all(book, out, names)
    assert set(written) == set(names)
    for name, path in written.items():
        assert spark.read.parquet(path).count() == BOOK_QUERIES[name](book).count()
    views = register_views(book)
    assert "vw_RedFlagCustomers" in views
    n = spark.sql("SELECT count(*) FROM vw_PortfolioHealth WHERE LoanStatus = 'Overdue'").collect()[0][0]
    assert n == 1
    assert spark.sql("SELECT count(*) FROM loans").collect()[0][0] == book.loans.count()
    listed = {r["viewName"] for r in list_views(spark).collect()}
    assert {"vw_portfoliohealth", "vw_redflagcustomers", "vw_segmentrankings"} <= {v.lower() for v in listed}


def test_lasting_views_in_a_database(spark):
    """Another session finds the snapshots and reads the views by name."""
    book = role_book(spark, random_tables(6))
    spark.sql("DROP DATABASE IF EXISTS rb_views CASCADE")
    names = register_views(book, "rb_views")
    assert "rb_views.transactions_clean" in names and "rb_views.vw_RedFlagCustomers" in names
    other = spark.newSession()
    assert other.table("rb_views.transactions_clean").count() == book.transactions_clean.count()
    assert other.table("rb_views.customers_final").count() == book.customers_final.count()
    for view, report in (("vw_PortfolioHealth", "vw_portfolio_health"), ("vw_RedFlagCustomers", "vw_red_flag_customers"),
                         ("vw_SegmentRankings", "vw_segment_rankings")):
        want = BOOK_QUERIES[report](book)
        got = other.table(f"rb_views.{view}")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    register_views(book, "rb_views")                       # again: refreshed, not doubled
    assert spark.newSession().table("rb_views.transactions_clean").count() == book.transactions_clean.count()
    spark.sql("DROP DATABASE rb_views CASCADE")


def test_find_tables(spark, tmp_path):
    for f in ("loans.csv", "accounts.parquet", "notes.txt", "customers.csv", "transactions.csv", "branches.csv"):
        (tmp_path / f).write_text("")
    root = f"file://{tmp_path}"
    assert find_tables(spark, root) == {
        "loans": f"{root}/loans.csv", "accounts": f"{root}/accounts.parquet", "customers": f"{root}/customers.csv",
        "transactions": f"{root}/transactions.csv", "branches": f"{root}/branches.csv"}


def test_missing_tables_are_errors(spark, tmp_path):
    (tmp_path / "loans.csv").write_text("")
    with pytest.raises(FileNotFoundError, match="customers, accounts, transactions, branches"):
        find_tables(spark, str(tmp_path))
    with pytest.raises(ValueError, match="tables missing: customers"):
        Book.from_paths(spark, {n: "x" for n in ("accounts", "loans", "transactions", "branches")})
