"""The loan rollup is built from the loans as given, by tasks whose size does
not grow with the input."""

from __future__ import annotations

from decimal import Decimal

import pytest

from riskbook.operators import portfolio
from riskbook.plans import materialize
from riskbook.session import size_in_bytes
from riskbook.sources.book import Book

SETTINGS = ("spark.sql.shuffle.partitions", *materialize.SMALL_TASKS)
LOANS = 6000


@pytest.fixture()
def paths(spark, tmp_path):
    """6000 loans of 1000 accounts (a tenth of one account, some without one),
    each loan of 100.25, in six files."""
    (spark.range(0, LOANS, 1, 6).selectExpr(
        "id AS LoanID", "CASE WHEN id % 10 = 0 THEN -1 WHEN id % 11 = 0 THEN NULL ELSE id % 1000 END AS AccountID",
        "CAST(CASE WHEN id % 13 = 0 THEN NULL ELSE id % 4 + 1 END AS int) AS LoanStatusID",
        "CAST(100.25 AS decimal(18,2)) AS PrincipalAmount",
        "CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE 0.05 END AS decimal(5,4)) AS InterestRate",
        "DATE '2020-01-01' AS StartDate", "DATE '2022-01-01' AS EstimatedEndDate")
     .write.parquet(str(tmp_path / "loans.parquet")))
    small = {
        "customers": "SELECT 1L CustomerID, 'A' FirstName, 'B' LastName, DATE '1950-01-01' DateOfBirth, 1L AddressID, "
                     "1 CustomerTypeID",
        "accounts": "SELECT id AccountID, 1L CustomerID, 1 AccountTypeID, 1 AccountStatusID, "
                    "CAST(5 AS decimal(18,2)) Balance FROM range(1000)",
        "transactions": "SELECT 1L TransactionID, 1L AccountOriginID, 1L AccountDestinationID, 1 TransactionTypeID, "
                        "CAST(1 AS decimal(18,2)) Amount, TIMESTAMP '2024-01-01 00:00:00' TransactionDate, 1L BranchID, "
                        "'x' Description",
        "branches": "SELECT 1L BranchID, 'Branch' BranchName, 1L AddressID",
    }
    for name, rows in small.items():
        spark.sql(rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    return {name: str(tmp_path / f"{name}.parquet") for name in ("loans", *small)}


def tables(spark, book):
    return {t.name for t in spark.catalog.listTables(book.store.name)}


def buckets(spark, book, table):
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {book.store.name}.{table}").collect()
    return int(next(r["data_type"] for r in described if r["col_name"] == "Num Buckets"))


def exposure():
    """The report's rows, counted in plain Python."""
    ids = [i for i in range(LOANS) if i % 13]
    n = {name: sum(i % 4 + 1 == code for i in ids) for code, name in ((1, "Active"), (2, "Paid Off"), (3, "Overdue"))}
    return {name: (k, k * Decimal("100.25"), Decimal("100.25")) for name, k in n.items()}


def rows(df):
    return {r["LoanStatus"]: tuple(r)[1:] for r in df.collect()}


def test_exposure_writes_the_rollup_and_no_loans(spark, paths):
    book = Book.from_paths(spark, paths).prepared()
    try:
        assert rows(portfolio.exposure_by_status(book)) == exposure()
        assert tables(spark, book) == {"loan_rollup"}
        assert book.loan_rollup.selectExpr("sum(rows)").first()[0] == LOANS
    finally:
        book.close()


def test_buckets_grow_with_the_input_and_are_alike(spark, paths, monkeypatch):
    monkeypatch.setattr(materialize, "INPUT_PER_BUCKET", 2048)
    book = Book.from_paths(spark, paths).prepared()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(portfolio.exposure_by_status(book)) == exposure()
        n = buckets(spark, book, "loan_rollup")
        assert n == book.store.buckets() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        segment = portfolio.exposure_by_segment(book)
        assert buckets(spark, book, "account_customers") == n
        plan = segment._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("SortMergeJoin"):]
        known = [i for i in range(LOANS) if i % 10 and i % 11]
        assert [tuple(r)[:3] for r in segment.collect()] == [
            (segment.first()["CustomerType"], len(known), len(known) * Decimal("100.25"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        book.close()


def test_settings_hold_only_while_a_table_is_written(spark, paths, monkeypatch):
    book = Book.from_paths(spark, paths).prepared()
    before, seen = {k: spark.conf.get(k) for k in SETTINGS}, {}
    save = book.store._save

    def saved(*args):
        seen.update({k: spark.conf.get(k) for k in SETTINGS})
        return save(*args)

    monkeypatch.setattr(book.store, "_save", saved)
    monkeypatch.setattr(book.store, "buckets", lambda: 24)
    try:
        book.loan_rollup  # noqa: B018 - written here
        assert seen["spark.sql.shuffle.partitions"] == "24"
        for k, most in materialize.SMALL_TASKS.items():
            assert size_in_bytes(seen[k]) == min(most, size_in_bytes(before[k]))
        assert {k: spark.conf.get(k) for k in SETTINGS} == before
        monkeypatch.setattr(book.store, "_save", lambda *args: 1 // 0)
        with pytest.raises(ZeroDivisionError):
            book.store.bucketed(book.accounts, "accounts", "AccountID")
        assert {k: spark.conf.get(k) for k in SETTINGS} == before
    finally:
        book.close()


@pytest.mark.parametrize("text,size", [("128MB", 128 << 20), ("16m", 16 << 20), ("134217728b", 1 << 27), ("4096", 4096),
                                       ("64kb", 1 << 16), ("2 GiB", 2 << 30), ("1t", 1 << 40)])
def test_size_settings(text, size):
    assert size_in_bytes(text) == size
