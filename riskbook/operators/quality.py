"""Data-quality operators (stage 1): audits, de-duplication, cleaning.

Generic operators take the frame and column names; the loan-book versions
below them fix the columns of the published analysis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_count, bucketize, clean_name, count_long, flag_sum, null_count, ts_literal
from ..sources.schemas import TRANSACTION_COLUMNS

# --- fixed values: labels of the published analysis -------------------------
RISK_EDGES = (Decimal("0.05"), Decimal("0.10"))
RISK_LABELS = ("Low Risk", "Medium Risk", "High Risk")
FUTURE_START = "Future Start — Anomaly"
END_BEFORE_START = "End Before Start — Anomaly"
VALID = "Valid"
PLACEHOLDER_NAME = "Unknown"
# ---------------------------------------------------------------------------


# -- generic operators --------------------------------------------------------

def null_audit(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One pass: total_rows and, per output name, the NULL count of a column."""
    aggs = [count_long("*").alias("total_rows")]
    aggs += [null_count(c).cast("long").alias(out) for out, c in columns.items()]
    return df.agg(*aggs)


def duplicate_keys(df: DataFrame, key: str, count_col: str = "cnt", limit: int | None = None) -> DataFrame:
    """Keys occurring more than once, with their row count."""
    out = df.groupBy(key).agg(count_long("*").alias(count_col)).filter(F.col(count_col) > 1)
    if limit is not None:
        out = out.orderBy(F.col(key).asc_nulls_first()).limit(limit)
    return out


def duplicate_key_count(df: DataFrame, key: str, out: str = "total_duplicate_rows") -> DataFrame:
    """Number of keys (not surplus rows) occurring more than once."""
    return duplicate_keys(df, key).agg(count_long("*").alias(out))


def dedupe_first(df: DataFrame, key: str, order_by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order_by`` (ascending, NULL first).

    ``order_by`` should end with a unique column so the kept row is
    determined.  The plan is a window with ``row_number() == 1``; Spark
    places a partial group limit before the shuffle, so a key holding a
    large share of the rows sends at most one row per input partition.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(*keep)


def dedupe_counted(df: DataFrame, key: str, order_by: Sequence[str], keep: Sequence[str],
                   count_col: str = "Copies") -> DataFrame:
    """``dedupe_first`` with the rows each key had, in one aggregate: the first
    row is the smallest struct of ``order_by`` and the other columns (NULL
    first), and both it and the count are combined before the shuffle."""
    fields = [*order_by, *[c for c in keep if c not in order_by and c != key]]
    out = df.groupBy(key).agg(F.min(F.struct(*fields)).alias("_first"), count_long("*").alias(count_col))
    return out.select(*[F.col(key) if c == key else F.col("_first")[c].alias(c) for c in keep], count_col)


def remaining_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Row count of every key still repeated; no rows when the key is unique."""
    return (
        df.groupBy(key)
        .agg(count_long("*").alias("remaining_duplicates"))
        .filter(F.col("remaining_duplicates") > 1)
        .select("remaining_duplicates")
    )


# -- loan-book operators ------------------------------------------------------

def null_audit_customers(book) -> DataFrame:
    """Q01."""
    return null_audit(book.customers, {
        "null_first_name": "FirstName",
        "null_last_name": "LastName",
        "null_dob": "DateOfBirth",
        "null_address_id": "AddressID",
        "null_customer_type": "CustomerTypeID",
    })


def null_audit_loans(book) -> DataFrame:
    """Q02."""
    return null_audit(book.loans, {
        "null_status": "LoanStatusID",
        "null_principal": "PrincipalAmount",
        "null_rate": "InterestRate",
        "null_start_date": "StartDate",
        "null_end_date": "EstimatedEndDate",
    })


def duplicate_transactions(book, limit: int | None = None) -> DataFrame:
    """Q03: TransactionID, cnt for ids seen more than once (a prepared Book
    kept each id's count when it removed the duplicates)."""
    if book.store is None:
        return duplicate_keys(book.transactions, "TransactionID", "cnt", limit)
    out = _repeated(book).select("TransactionID", F.col("Copies").alias("cnt"))
    return out if limit is None else out.orderBy(F.col("TransactionID").asc_nulls_first()).limit(limit)


def _repeated(book) -> DataFrame:
    return book.transactions_by_month.filter(F.col("Copies") > 1)


def blank_audit_customers(book) -> DataFrame:
    """Q04: empty-string names (NULL names are not counted)."""
    c = book.customers
    first_blank = F.col("FirstName") == F.lit("")
    last_blank = F.col("LastName") == F.lit("")
    return c.agg(
        blank_count("FirstName").cast("long").alias("empty_first_name"),
        blank_count("LastName").cast("long").alias("empty_last_name"),
        flag_sum(first_blank | last_blank).cast("long").alias("total_bad_name_rows"),
    )


def duplicate_transaction_count(book) -> DataFrame:
    """Q05."""
    if book.store is None:
        return duplicate_key_count(book.transactions, "TransactionID")
    return _repeated(book).agg(count_long("*").alias("total_duplicate_rows"))


def dedupe_transactions(book) -> DataFrame:
    """Q06: first row per TransactionID by TransactionDate, then tie-breakers."""
    return dedupe_first(book.transactions, "TransactionID", transaction_order(book), TRANSACTION_COLUMNS)


def transaction_order(book) -> list[str]:
    """What decides which row of a TransactionID comes first."""
    order = ["TransactionDate", *book.tx_tiebreak]
    if not book.tx_tiebreak:                    # no unique source row: every column decides
        order += [c for c in TRANSACTION_COLUMNS if c not in order and c != "TransactionID"]
    return order


def verify_dedupe(book) -> DataFrame:
    """Q07."""
    return remaining_duplicates(book.transactions_clean, "TransactionID")


def loan_risk_bucket(book, limit: int | None = None) -> DataFrame:
    """Q08: every loan with its risk label (NULL rate -> highest label)."""
    out = book.loans.select(
        "LoanID", "PrincipalAmount", "InterestRate",
        bucketize("InterestRate", RISK_EDGES, RISK_LABELS).alias("RiskCategory"),
    )
    if limit is not None:
        out = out.orderBy(*[F.col(c).asc_nulls_first() for c in out.columns]).limit(limit)
    return out


def loan_date_anomalies(book, as_of: str | None = None, limit: int | None = None) -> DataFrame:
    """Q09: loans starting after ``as_of`` (midnight; default today) or
    ending before they start."""
    today = ts_literal(as_of) if as_of is not None else F.current_date().cast("timestamp_ntz")
    start, end = F.col("StartDate"), F.col("EstimatedEndDate")
    future, backwards = start > today, end < start
    label = F.when(future, F.lit(FUTURE_START)).when(backwards, F.lit(END_BEFORE_START)).otherwise(F.lit(VALID))
    out = book.loans.filter(future | backwards).select(
        "LoanID", "StartDate", "EstimatedEndDate", label.alias("DateCheck")
    )
    if limit is not None:
        out = out.orderBy(*[F.col(c).asc_nulls_first() for c in out.columns]).limit(limit)
    return out


def clean_customers(book) -> DataFrame:
    """Q10: trimmed names, blank or NULL -> 'Unknown'."""
    return book.customers.select(
        "CustomerID",
        clean_name("FirstName", PLACEHOLDER_NAME).alias("FirstName"),
        clean_name("LastName", PLACEHOLDER_NAME).alias("LastName"),
        "DateOfBirth", "AddressID", "CustomerTypeID",
    )


def placeholder_name_count(book) -> DataFrame:
    """Q11."""
    c = book.customers_final
    hit = (F.col("FirstName") == PLACEHOLDER_NAME) | (F.col("LastName") == PLACEHOLDER_NAME)
    return c.filter(hit).agg(count_long("*").alias("bad_name_rows"))
