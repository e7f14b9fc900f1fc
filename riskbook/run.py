"""Run the whole analysis: every report written out, views registered.

    python -m riskbook --tables DIR --out DIR [--reports a,b,...]

``DIR`` (any store that Spark reads) holds the role tables as ``<role>.csv``
(with a header) or ``<role>.parquet``: customers, accounts, loans,
transactions, branches (all required) and optionally the code tables.  Each
report is written as parquet under ``--out/<report>`` by the executors;
nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .operators import portfolio, ranking, solvency
from .registry import BOOK_QUERIES
from .session import input_bytes, sized_conf
from .sources import schemas
from .sources.book import REQUIRED, Book
from .views import create_views


def register_views(book: Book, database: str | None = None) -> list[str]:
    """The role tables, the snapshots and the three report views by name.

    Without ``database`` they are temp views of this session.  With one, the
    snapshots and tables are written there under their own names and the
    report views are lasting SQL views over them, for other sessions; calling
    it again refreshes the tables.
    """
    if database is not None:
        lasting = book.prepared(database)
        lasting.loans, lasting.transactions_clean, lasting.customers_final, lasting.loan_rollup  # noqa: B018 - written by name
        for name in ("customers", "accounts", "branches"):
            lasting.store.plain(getattr(book, name), name)
        for name, df in book.codes.items():
            lasting.store.plain(df, name)
        names = ["customers", "accounts", "branches", *book.codes, "loans", "transactions_clean", "customers_final",
                 "loan_rollup"]
        return [f"{database}.{n}" for n in names] + create_views(book.spark, database)
    tables = {
        "customers": book.customers, "accounts": book.accounts, "loans": book.loans,
        "transactions": book.transactions, "branches": book.branches,
        "transactions_clean": book.transactions_clean, "customers_final": book.customers_final,
        **book.codes,
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    portfolio.vw_portfolio_health(book, register=True)
    solvency.vw_red_flag_customers(book, register=True)
    ranking.vw_segment_rankings(book, register=True)
    return [*tables, "vw_PortfolioHealth", "vw_RedFlagCustomers", "vw_SegmentRankings"]


def list_views(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The registered views, from the session catalog (namespace, viewName,
    isTemporary)."""
    return spark.sql(f"SHOW VIEWS IN {database}" if database else "SHOW VIEWS")


def run_all(book: Book, out_dir: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Write each report as parquet under ``out_dir/<name>``."""
    written = {}
    for name in names or sorted(BOOK_QUERIES):
        path = f"{out_dir.rstrip('/')}/{name}"
        BOOK_QUERIES[name](book).write.mode("overwrite").parquet(path)
        written[name] = path
    return written


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds ``path`` (in any store it reads)."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def find_tables(spark: SparkSession, table_dir: str) -> dict[str, str]:
    """Role table files in a folder, by role name; a missing required table
    is an error."""
    found = {}
    for name in schemas.BY_NAME:
        for ext in (".parquet", ".csv"):
            path = f"{table_dir.rstrip('/')}/{name}{ext}"
            if _exists(spark, path):
                found[name] = path
                break
    missing = [n for n in REQUIRED if n not in found]
    if missing:
        raise FileNotFoundError(f"{table_dir} holds no {', '.join(missing)} (.parquet or .csv)")
    return found


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="riskbook", description=__doc__.split("\n\n")[0])
    ap.add_argument("--tables", required=True, help="folder with <role>.csv / <role>.parquet files")
    ap.add_argument("--out", required=True, help="folder for the report outputs (a shared path on a cluster)")
    ap.add_argument("--reports", default="", help="comma-separated report names (default: all)")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("riskbook").config("spark.ui.enabled", "false").getOrCreate()
    paths = find_tables(spark, args.tables)
    for key, value in sized_conf(input_bytes(spark, list(paths.values())),
                                 spark.sparkContext.defaultParallelism).items():
        spark.conf.set(key, value)
    book = Book.from_paths(spark, paths).prepared()
    names = [n for n in args.reports.split(",") if n] or None
    try:
        for name, path in run_all(book, args.out, names).items():
            print(f"{name}\t{path}")
    finally:
        book.close()
