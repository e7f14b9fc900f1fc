"""Snapshots kept up to date in place, and reports that read their by-products."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest

from riskbook.operators import portfolio, quality, trend
from riskbook.plans.inspect import count_exchanges, physical_plan

from .fixtures import role_book

D = Decimal


def tx(tid, acct, day, amount="1.00", row=0):
    ts = None if day is None else dt.datetime.fromisoformat(day)
    return (tid, acct, acct, 1, D(amount), ts, 1, "t", row)


OLD = ([tx(i, i % 7, f"2024-0{1 + i % 5}-1{i % 9}", f"{i}.50", i) for i in range(60)]
       + [tx(3, 1, "2024-02-01", row=100), tx(None, 2, "2024-01-09", row=101), tx(70, 5, None, row=102)])
NEW = [tx(200, 1, "2024-03-28", "9.00", 500),        # a new id
       tx(7, 2, "2024-03-13", "8.00", 501),          # March again; its old row has the earlier date
       tx(12, 5, "2024-03-02", "7.00", 502),         # earlier than its old row, same month
       tx(12, 5, "2024-03-02", "6.00", 503)]         # and twice


def book_of(spark, rows):
    return role_book(spark, {"transactions": rows, "customers": [], "accounts": [], "loans": [], "branches": []})


def files(book):
    df = book.transactions_by_month.selectExpr("TxMonth", "input_file_name() AS f").distinct()
    out = {}
    for r in df.collect():
        path = r["f"].removeprefix("file://")
        out.setdefault(r["TxMonth"], set()).add((path, os.stat(path).st_mtime_ns))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def books(spark):
    made = []

    def make(rows):
        made.append(book_of(spark, rows).prepared())
        return made[-1]
    yield make
    for b in made:
        b.close()


def same_reports(a, b):
    for report in (quality.dedupe_transactions, quality.duplicate_transactions, quality.duplicate_transaction_count,
                   quality.verify_dedupe, trend.monthly_transaction_trend,
                   lambda x: trend.top_accounts_by_volume(x, "2024-02-10", None)):
        assert rows_of(report(a)) == rows_of(report(b))
    assert rows_of(a.transactions_by_month.select(*sorted(a.transactions_by_month.columns))) == \
        rows_of(b.transactions_by_month.select(*sorted(b.transactions_by_month.columns)))
    assert rows_of(a.tx_accounts) == rows_of(b.tx_accounts)


def test_adding_rows_of_one_month_rewrites_one_directory(spark, books):
    new = [r for r in NEW if r[0] != 7]
    book = books(OLD).load()
    before = files(book)
    book.append_transactions(book_of(spark, new).transactions)
    after = files(book)
    changed = {m for m in before.keys() | after.keys() if before.get(m) != after.get(m)}
    assert changed == {"2024-03"}
    same_reports(book, books(OLD + new))


@pytest.mark.parametrize("new", [NEW, [tx(None, 1, "2023-12-31", row=900)], [tx(70, 5, "2024-01-01", row=901)],
                                 [tx(i, 1, "2020-01-01", row=1000 + i) for i in range(60)], []],
                         ids=["mixed", "null-id", "null-date-stays", "months-left-empty", "nothing"])
def test_refresh_equals_a_full_rebuild(spark, books, new):
    book = books(OLD).load()
    book.append_transactions(book_of(spark, new).transactions)
    same_reports(book, books(OLD + new))
    again = [tx(200, 1, "2024-03-01", row=2000)]
    book.append_transactions(book_of(spark, again).transactions)
    same_reports(book, books(OLD + new + again))


def test_appended_customers_are_cleaned_and_bucketed(spark, books):
    old = [(i, " Ann ", None, None, 1, 1) for i in range(20)]
    new = [(i, "", "  ", None, 1, 2) for i in range(20, 25)]
    accounts = [(i, i, 1, 1, D("1.00")) for i in range(25)]

    def make(rows):
        return role_book(spark, {"customers": rows, "accounts": accounts}).prepared()

    book, whole = make(old).load(), make(old + new)
    book.append_customers(role_book(spark, {"customers": new}).customers)
    for report in (quality.clean_customers, quality.placeholder_name_count, portfolio.customer_accounts,
                   lambda b: b.customers_final, lambda b: b.clustered("customers_final").select("CustomerID")):
        assert rows_of(report(book)) == rows_of(report(whole))
    assert "Bucketed: true" in physical_plan(book.customers_final.groupBy("CustomerID").count())
    book.close()
    whole.close()


def test_duplicates_shuffle_no_transactions(books):
    book = books(OLD).load()
    assert count_exchanges(quality.duplicate_transactions(book)) == 0
    p = physical_plan(quality.duplicate_transactions(book))
    assert "PushedFilters: [IsNotNull(Copies), GreaterThan(Copies,1)]" in p
    assert count_exchanges(quality.duplicate_transaction_count(book)) == 1      # one count per task


def test_top_accounts_read_one_month_of_transactions(books):
    book = books(OLD).load()
    p = physical_plan(trend.top_accounts_by_volume(book, "2024-02-10"))
    raw = next(ln for ln in p.splitlines() if "Scan" in ln and "transactions_clean[" in ln)
    assert "(TxMonth" in raw and "= 2024-02)" in raw
    assert "tx_months[" in p
    assert "transactions_clean" not in physical_plan(trend.monthly_transaction_trend(book))
