"""The typed readers (S1, S2) and the command line on files written here:
every published table as a header CSV (an empty transaction file among
them), and the same tables as parquet."""

from __future__ import annotations

import csv
import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest

from riskbook import run
from riskbook.operators import portfolio, quality, trend
from riskbook.sources import schemas
from riskbook.sources.book import Book
from riskbook.sources.readers import CSV_TABLES, read_csv_table, read_parquet_table

D = Decimal
CODES = {"customer_types": ["Individual", "Small Business", "Large Enterprise"],
         "account_types": ["1-URGENT", "2-HIGH"], "account_statuses": ["Active", "Closed"],
         "loan_statuses": ["Active", "Paid Off", "Overdue"], "transaction_types": ["Deposit"]}


def loans():
    rows = []
    for i in range(120):
        start = None if i % 17 == 0 else dt.datetime(2021 + i % 3, 1 + i % 12, 1 + i % 28, 8, 30)
        end = None if start is None else start + dt.timedelta(days=365 if i % 19 else -5)
        rows.append((1000 + i - (i % 40 == 1), 10 + i % 9, 1 + i % 3, D(i * 317 % 9001) + D("0.25"),
                     None if i % 23 == 0 else D(i % 20) / 100, start, end))
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")

    def write(name, header, rows):
        with open(root / f"{name}.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(header)
            for r in rows:
                w.writerow(["" if x is None else x for x in r])

    names = {n: [f.name for f in schemas.BY_NAME[n].fields] for n in schemas.BY_NAME}
    write("loans", names["loans"], loans())
    for code, values in CODES.items():
        write(code, names[code], list(enumerate(values, 1)))
    write("branches", names["branches"], [(i, f"Branch {i}", i) for i in range(1, 6)])
    write("customers", names["customers"], [(i, f"F{i}", f"L{i}", "1980-01-01", 1, 1 + i % 3) for i in range(1, 6)])
    write("accounts", names["accounts"], [(10 + i, 1 + i % 5, 1, 1, f"{i * 100}.50") for i in range(9)])
    (root / "transactions.csv").write_text("\r\n")
    return root


def totals(status):
    return sum((r[3] for r in loans() if r[2] == status), D(0))


def test_csv_tables_are_typed(spark, folder):
    t = {n: read_csv_table(spark, n, f"file://{folder}/{n}.csv") for n in CSV_TABLES}
    for n, df in t.items():
        assert [(f.name, f.dataType) for f in df.schema.fields] == [
            (f.name, f.dataType) for f in schemas.BY_NAME[n].fields]
    assert t["transactions"].count() == 0
    got = sorted((tuple(r) for r in t["loans"].collect()), key=str)
    assert got == sorted(loans(), key=str)


def test_parquet_tables_are_cast(spark, folder, tmp_path):
    df = read_csv_table(spark, "loans", f"{folder}/loans.csv")
    df.selectExpr("cast(LoanID AS int) AS LoanID", "*").drop(df["LoanID"]).withColumn("extra", df["AccountID"]).write.parquet(
        f"{tmp_path}/loans.parquet")
    back = read_parquet_table(spark, "loans", f"{tmp_path}/loans.parquet")
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_a_malformed_row_is_an_error(spark, folder, tmp_path):
    text = (folder / "loans.csv").read_text() + "x,1,1,1.00,0.1,,\n"
    (tmp_path / "loans.csv").write_text(text)
    with pytest.raises(Exception):
        read_csv_table(spark, "loans", f"{tmp_path}/loans.csv").collect()


@pytest.mark.parametrize("prepared", [False, True])
def test_reports_over_the_files(spark, folder, prepared):
    b = Book.from_csv(spark, f"file://{folder}")
    b = b.prepared() if prepared else b
    ex = {r["LoanStatus"]: (r["TotalLoans"], r["TotalPrincipal"]) for r in portfolio.exposure_by_status(b).collect()}
    assert ex == {CODES["loan_statuses"][s - 1]: (40, totals(s)) for s in (1, 2, 3)}
    audit = quality.null_audit_loans(b).first()
    assert (audit["total_rows"], audit["null_rate"]) == (120, sum(r[4] is None for r in loans()))
    by = defaultdict(D)
    for r in loans():
        by[None if r[5] is None else f"{r[5]:%Y-%m}"] += r[3]
    assert {r["LoanMonth"]: r["MonthlyExposure"] for r in trend.running_exposure(b).collect()} == dict(by)
    assert quality.loan_risk_bucket(b, limit=20).count() == 20
    b.close()


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    kept = {k: spark.conf.get(k, None) for k in run.sized_conf(0, 1)}
    try:
        run.main(["--tables", f"file://{folder}", "--out", str(tmp_path / "out"), "--reports",
                  "exposure_by_status,integrity_summary,credit_health_score"])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert spark.read.parquet(f"{tmp_path}/out/exposure_by_status").count() == 3
    summary = {r["relationship"]: r["orphan_count"] for r in
               spark.read.parquet(f"{tmp_path}/out/integrity_summary").collect()}
    assert len(summary) == 6 and set(summary.values()) == {0}
