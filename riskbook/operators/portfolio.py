"""Relationship joins and portfolio exposure (stages 3, 4, 7 and 8a).

Row-level reports (the loan book) are one shuffle join of loans against
the account dimension, hot accounts split off (``plans.chain``).
Exposure reports read the loan rollup (sums per account and status):
status-level ones name each status in the scan stage (a CASE over the fixed
code list, or a broadcast join for a code table read from data) and
aggregate map-side, so the only shuffle carries one row per status per
task; segment-level ones join it to the account dimension, bucketed alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean2, money, pct
from ..plans import chain
from ..sources.lookups import STATUS_OVERDUE


def _limit(df: DataFrame, order, limit: int | None) -> DataFrame:
    """A total order: the report's keys, then every other column."""
    return df if limit is None else df.orderBy(*dict.fromkeys(order)).limit(limit)


# -- stage 3: relationship joins ---------------------------------------------

def customer_accounts(book, limit: int | None = None) -> DataFrame:
    """Q20: customer, type, account, account type and status, balance."""
    a = _account_codes(book, chain.account_dim(book, extra=("AccountTypeID", "AccountStatusID")))
    out = a.select(
        "CustomerID", "CustomerName", "CustomerType", "AccountID", "AccountType", "AccountStatus", "Balance"
    )
    return _limit(out, ["CustomerID", "AccountID", *out.columns], limit)


def _account_codes(book, a: DataFrame) -> DataFrame:
    """Accounts with a known type and status: + AccountType, AccountStatus."""
    a = chain.with_code(book, a, "account_types", "AccountTypeID", "AccountType")
    return chain.with_code(book, a, "account_statuses", "AccountStatusID", "AccountStatus")


def _loan_book(book, extra_acct=()) -> DataFrame:
    """Loans with status joined to their account and customer."""
    a = chain.account_dim(book, extra=extra_acct)
    return chain.join_accounts(book, chain.loans_with_status(book), a)


def customer_loans(book, limit: int | None = None) -> DataFrame:
    """Q21: the core chain, one row per loan."""
    out = _loan_book(book).select(
        "CustomerID", "CustomerName", "CustomerType", "AccountID",
        F.col("Balance").alias("AccountBalance"), "LoanID", "PrincipalAmount", "InterestRate", "LoanStatus",
    )
    return _limit(out, ["CustomerID", "AccountID", "LoanID", *out.columns], limit)


def master_portfolio(book, limit: int | None = None) -> DataFrame:
    """Q22: every dimension joined, one row per loan."""
    a = _account_codes(book, chain.account_dim(book, extra=("AccountTypeID", "AccountStatusID")))
    out = chain.join_accounts(book, chain.loans_with_status(book), a).select(
        "CustomerID", "CustomerName", "CustomerType", "AccountID", "AccountType", "AccountStatus",
        F.col("Balance").alias("AccountBalance"), "LoanID", "PrincipalAmount",
        money(F.col("InterestRate") * 100).alias("InterestRate_Pct"),
        "LoanStatus", "StartDate", "EstimatedEndDate",
    )
    return _limit(out, ["CustomerID", "AccountID", "LoanID", *out.columns], limit)


def loan_transaction_summary(book, limit: int | None = None) -> DataFrame:
    """Q23: per loan, the transaction count and volume of its account.

    Transactions are first reduced to one row per account (rows n, volume
    v).  Loans then join that account row once, and are grouped by the
    report keys, which include AccountID, so the grouping reuses the join's
    partitioning: one shuffle of loans.  Repeated loan rows (multiplicity m)
    give count m * n and volume m * v, without building the loan x
    transaction fan-out.  No transactions -> 0 and NULL.
    """
    keys = ["CustomerID", "CustomerName", "CustomerType", "AccountID", "Balance",
            "LoanID", "PrincipalAmount", "LoanStatus"]
    loans = chain.loans_with_status(book).select("AccountID", "LoanID", "PrincipalAmount", "LoanStatus")
    acct = chain.account_dim(book).join(chain.tx_per_account(book), "AccountID", "left")

    def per_loan(rows: DataFrame, more: list[str]) -> DataFrame:
        return rows.groupBy(*keys, *more).agg(
            F.sum(F.coalesce(F.col("tx_ids"), F.lit(0))).cast("long").alias("TotalTransactions"),
            money(F.sum("tx_volume")).alias("TotalTransactionVolume"),
        )

    out = chain.join_accounts(book, loans, acct, then=per_loan,
                              spread_by=["LoanID", "PrincipalAmount", "LoanStatus"]).select(
        "CustomerID", "CustomerName", "CustomerType", "AccountID",
        F.col("Balance").alias("AccountBalance"), "LoanID", "PrincipalAmount", "LoanStatus",
        "TotalTransactions", "TotalTransactionVolume",
    )
    return _limit(out, ["CustomerID", "AccountID", "LoanID", *out.columns], limit)


def accounts_without_loans(book, limit: int | None = None) -> DataFrame:
    """Q24: accounts (with a known customer and type) holding no loan.

    The test is on the loan id after an outer join, so an account matched
    only by loan rows without an id also appears, once per such row.
    """
    cols = ["CustomerID", "CustomerName", "CustomerType", "AccountID", "Balance"]
    a = chain.account_dim(book)
    no_match = a.join(chain.loan_accounts(book), "AccountID", "left_anti").select(*cols)
    id_less = book.loans.filter(F.col("LoanID").isNull()).select("AccountID")
    out = no_match.unionByName(chain.join_accounts(book, id_less, a).select(*cols))
    return _limit(out, ["CustomerID", "AccountID", *out.columns], limit)


# -- stage 4: exposure ---------------------------------------------------------

def _by_status(book, *aggs) -> DataFrame:
    return chain.rollup_with_status(book).groupBy("LoanStatus").agg(*aggs)


def _count():
    return F.sum("ids")


def _rate_pct():
    return mean2(F.sum("r") * 100, F.sum("rn"))


def exposure_by_status(book) -> DataFrame:
    """Q25."""
    return _by_status(
        book,
        _count().alias("TotalLoans"),
        money(F.sum("p")).alias("TotalPrincipal"),
        mean2(F.sum("p"), F.sum("pn")).alias("AvgLoanSize"),
    ).orderBy(F.col("TotalPrincipal").desc_nulls_last())


def yield_by_status(book) -> DataFrame:
    """Q26."""
    return _by_status(
        book,
        money(F.sum("p")).alias("TotalPrincipal"),
        money(F.sum("pr")).alias("ExpectedYield"),
        _rate_pct().alias("AvgInterestRate_Pct"),
    ).orderBy(F.col("ExpectedYield").desc_nulls_last())


def _health(book, count_name: str) -> DataFrame:
    """Per status: count, principal, yield and share of all loans.  The
    share is a window over the few aggregated rows, never over loans."""
    agg = _by_status(
        book,
        _count().alias(count_name),
        money(F.sum("p")).alias("TotalPrincipal"),
        money(F.sum("pr")).alias("ExpectedYield"),
    )
    total = F.sum(count_name).over(Window.partitionBy())
    return agg.withColumn("PctOfPortfolio", pct(F.col(count_name), total))


def portfolio_scorecard(book) -> DataFrame:
    """Q27."""
    return _health(book, "LoanCount").orderBy(F.col("TotalPrincipal").desc_nulls_last())


def exposure_by_segment(book) -> DataFrame:
    """Q28: loans (any status) per customer type."""
    seg = book.loan_rollup.join(chain.account_dim(book), "AccountID").groupBy("CustomerType").agg(
        _count().alias("TotalLoans"),
        money(F.sum("p")).alias("TotalExposure"),
        money(F.sum("pr")).alias("ExpectedYield"),
        _rate_pct().alias("AvgInterestRate_Pct"),
    )
    return seg.orderBy(F.col("TotalExposure").desc_nulls_last())


def overdue_exposure(book) -> DataFrame:
    """Q29: one row over overdue loans."""
    return chain.rollup_with_status(book, only=STATUS_OVERDUE).agg(
        money(F.sum("p")).alias("OverduePrincipal"),
        money(F.sum("pr")).alias("OverdueExpectedYield"),
        F.coalesce(_count(), F.lit(0)).alias("OverdueLoanCount"),
        _rate_pct().alias("AvgOverdueRate_Pct"),
    )


# -- stage 7: tuned queries ------------------------------------------------------

def loans_by_status(book, status_id: int = 2) -> DataFrame:
    """Q40: point filter, pushed into the parquet scan."""
    return book.loans.filter(F.col("LoanStatusID") == status_id).select(
        "LoanID", "PrincipalAmount", "LoanStatusID"
    )


def portfolio_slim(book, limit: int | None = None) -> DataFrame:
    """Q42: the core chain, 8 columns."""
    out = _loan_book(book).select(
        "CustomerID", "CustomerName", "CustomerType", "AccountID",
        F.col("Balance").alias("AccountBalance"), "LoanID", "PrincipalAmount", "LoanStatus",
    )
    return _limit(out, ["CustomerID", "AccountID", "LoanID", *out.columns], limit)


# -- stage 8a: portfolio health view ----------------------------------------------

def vw_portfolio_health(book, register: bool = False) -> DataFrame:
    """Q44: the health view (no order)."""
    df = _health(book, "TotalLoans")
    if register:
        df.createOrReplaceTempView("vw_PortfolioHealth")
    return df


def vw_portfolio_health_overdue(book) -> DataFrame:
    """Q45: the share is computed over all statuses before the filter."""
    return vw_portfolio_health(book).filter(F.col("LoanStatus") == STATUS_OVERDUE)


def vw_portfolio_health_sorted(book) -> DataFrame:
    """Q46."""
    return vw_portfolio_health(book).orderBy(F.col("TotalPrincipal").desc_nulls_last())


def customers_with_loans(book, limit: int | None = None) -> DataFrame:
    """Q52: distinct customers owning an account that has a loan."""
    owners = book.accounts.join(chain.loan_accounts(book), "AccountID", "left_semi").select("CustomerID").distinct()
    out = book.customers_final.join(owners, "CustomerID", "left_semi").select(
        "CustomerID", "FirstName", "LastName"
    ).distinct()
    return _limit(out, ["CustomerID", *out.columns], limit)

