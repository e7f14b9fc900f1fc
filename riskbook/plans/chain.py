"""The customer -> account -> loan chain, shaped for scale.

Loans are the largest table, so aggregate queries collapse them per account
before any join (a partial aggregate before the shuffle also absorbs a hot
account), and only then join the account dimension (one row per account,
bucketed on AccountID in a prepared Book).  Row-level reports
join loans to that dimension with ``join_accounts``, which spreads the rows
of hot accounts over tasks by a salt (``skew.py``).

Reports on exposure, debt, rates and yields read the loan rollup instead of
loans: additive sums per (account, status), from which every such figure
follows exactly.

Inner joins drop rows whose key finds no partner, as in the chained joins
of the analysis: a customer with an unknown type code, an account with an
unknown customer, a loan with an unknown status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_name
from ..sources import schemas
from ..sources.lookups import STATUS_OVERDUE, STATUS_PAID_OFF
from .skew import salted_join


def with_code(book, df: DataFrame, table: str, key: str, out: str, only: str | None = None) -> DataFrame:
    """Rows whose ``key`` is listed in code table ``table``, with the code's
    name as ``out`` (inner-join semantics; ``only`` keeps one name).

    A code table that is the fixed list becomes a CASE expression and an
    ``isin`` filter evaluated in the scan stage (no join, no broadcast job;
    on a partition column the filter prunes directories).  A code table read
    from data is joined (broadcast after its size check).
    """
    pairs = book.fixed_code_pairs(table)
    if pairs is None:
        name_col = schemas.BY_NAME[table].fields[1].name
        dim = book.code(table).select(key, F.col(name_col).alias(out))
        if only is not None:
            dim = dim.filter(F.col(out) == only)
        return df.join(dim, key)
    if only is not None:
        pairs = [(i, n) for i, n in pairs if n == only]
    if not pairs:
        return df.filter(F.lit(False)).withColumn(out, F.lit(None).cast("string"))
    arms = " ".join(f"WHEN {int(i)} THEN '{_sql_text(n)}'" for i, n in pairs)
    name = F.expr(f"CASE `{key}` {arms} END")
    return df.filter(F.col(key).isin([i for i, _ in pairs])).withColumn(out, name)


def _sql_text(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def code_unknown(book, table: str, key: str) -> Column | None:
    """True where ``key`` is NULL or not in the fixed code list (the rows an
    anti join would keep); None when the code table is read from data."""
    pairs = book.fixed_code_pairs(table)
    if pairs is None:
        return None
    k = F.col(key)
    return k.isNull() | ~k.isin([i for i, _ in pairs])


def customer_dim(book, with_type: bool = True) -> DataFrame:
    """CustomerID, CustomerName, FirstName, LastName[, CustomerType]."""
    c = book.customers_final.select(
        "CustomerID", "FirstName", "LastName", "CustomerTypeID",
        full_name("FirstName", "LastName").alias("CustomerName"),
    )
    if with_type:
        c = with_code(book, c, "customer_types", "CustomerTypeID", "CustomerType")
    return c.drop("CustomerTypeID")


ACCOUNT_DIM_COLUMNS = ["AccountID", "CustomerID", "Balance", "AccountTypeID", "AccountStatusID",
                       "FirstName", "LastName", "CustomerName", "CustomerType"]


def build_account_customers(book) -> DataFrame:
    """Accounts joined to customers with a known type (account scale).

    Customers holding very many accounts (or one orphan id shared by many)
    are spread by a salt, like hot accounts are for loans; the hot customer
    ids are found when a prepared Book is built.
    """
    a = book.accounts.select("AccountID", "CustomerID", "Balance", "AccountTypeID", "AccountStatusID")
    hot = book.hot_keys("accounts.CustomerID")
    return salted_join(a, customer_dim(book), "CustomerID", hot).select(*ACCOUNT_DIM_COLUMNS)


def account_dim(book, extra: Sequence[str] = ()) -> DataFrame:
    """One row per account with its customer's id, name and type."""
    return book.account_customers.select(
        "AccountID", "CustomerID", "Balance", "CustomerName", "CustomerType", *extra
    )


def loans_with_status(book, only: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Loans (``rows`` of them, if given) with a known status: + LoanStatus
    (``only`` keeps one status)."""
    return with_code(book, book.loans if rows is None else rows, "loan_statuses", "LoanStatusID", "LoanStatus", only)


def is_status(name: str) -> Column:
    return F.when(F.col("LoanStatus") == F.lit(name), F.lit(1)).otherwise(F.lit(0))


def overdue_flag() -> Column:
    return is_status(STATUS_OVERDUE)


def paid_off_flag() -> Column:
    return is_status(STATUS_PAID_OFF)


def join_accounts(book, loans: DataFrame, dim: DataFrame, how: str = "inner", then=None,
                  spread_by: Sequence[str] = ()) -> DataFrame:
    """Loan rows joined to a one-row-per-account dimension, the rows of hot
    accounts (found at load) spread by a salt; ``then`` and ``spread_by`` as
    in ``salted_join``."""
    return salted_join(loans, dim, "AccountID", book.hot_keys("loans.AccountID"), how, then, spread_by)


def build_loan_rollup(book) -> DataFrame:
    """Additive sums of loans per (account, status), NULLs being groups too:
    rows and loan ids, principal (sum, count), rate (sum, count), principal x
    rate, and the principal that has a rate (for shifted rates).  It reads the
    loans as they are given: sums need no layout, so none is written for them."""
    p, r = F.col("PrincipalAmount"), F.col("InterestRate")
    return book.raw_loans.groupBy("AccountID", "LoanStatusID").agg(
        F.count(F.lit(1)).alias("rows"), F.count("LoanID").alias("ids"),
        F.sum(p).alias("p"), F.count(p).alias("pn"), F.sum(r).alias("r"), F.count(r).alias("rn"),
        F.sum(p * r).alias("pr"), F.sum(F.when(r.isNotNull(), p)).alias("p_rated"),
    )


def rollup_with_status(book, only: str | None = None) -> DataFrame:
    """The loan rollup for known statuses: + LoanStatus (``only`` keeps one)."""
    return with_code(book, book.loan_rollup, "loan_statuses", "LoanStatusID", "LoanStatus", only)


def rollup_per_account(rollup: DataFrame, **sums: str | Column) -> DataFrame:
    """The rollup added up to one row per AccountID: ``name=column``."""
    return rollup.groupBy("AccountID").agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def loan_accounts(book) -> DataFrame:
    """Distinct AccountIDs that carry a loan, from the rollup."""
    return book.loan_rollup.select("AccountID").distinct()


def aggregate_tx_months(book) -> DataFrame:
    """Cleaned transactions per month and origin account: rows, ids, volume."""
    return (
        book.transactions_by_month.groupBy("TxMonth", "AccountOriginID")
        .agg(
            F.count(F.lit(1)).alias("tx_rows"),
            F.count("TransactionID").alias("tx_ids"),
            F.sum("Amount").alias("tx_volume"),
        )
    )


def aggregate_tx(book) -> DataFrame:
    """The same per origin account, added up from the months."""
    return book.tx_months.groupBy(F.col("AccountOriginID").alias("AccountID")).agg(
        *[F.sum(c).alias(c) for c in ("tx_rows", "tx_ids", "tx_volume")])


def tx_per_account(book) -> DataFrame:
    """The same, from the table a prepared Book keeps."""
    return book.tx_accounts
