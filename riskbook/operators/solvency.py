"""Solvency: debt, assets, liquidity gap, debt-to-asset ratio, red flags
(stage 5 and the red-flag views of stage 8a).

Debts come from the loan rollup, added up to one row per account.  Assets are the SUM of
DISTINCT balances over the accounts that carry a counted loan, so two
accounts with an equal balance count once, and accounts without loans
are not seen (unlike ``assets_per_customer``).  The ratio guards a zero
denominator: all-zero balances give a NULL ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money, ratio4
from ..plans import chain
from ..sources.lookups import STATUS_OVERDUE

# --- fixed values -----------------------------------------------------------
LARGE_ENTERPRISE = "Large Enterprise"
TOP_N = 20
# ---------------------------------------------------------------------------

_CUST = ["CustomerID", "CustomerName", "CustomerType"]


def _top(df: DataFrame, by: str, n: int | None) -> DataFrame:
    out = df.orderBy(F.col(by).desc_nulls_last(), F.col("CustomerID").asc_nulls_first())
    return out if n is None else out.limit(n)


def _debt_and_assets(book, rollup: DataFrame) -> DataFrame:
    """Per customer: debt (SUM principal) and assets (SUM DISTINCT balance
    of the accounts those loans sit on), both unrounded."""
    per_acct = chain.rollup_per_account(rollup, _debt="p")
    return _named(book, _accounts(book, per_acct).groupBy("CustomerID").agg(
        F.sum("_debt").alias("_debt"),
        F.sum_distinct("Balance").alias("_assets"),
    ))


def _accounts(book, per_acct: DataFrame) -> DataFrame:
    return per_acct.join(chain.account_dim(book).select("AccountID", "CustomerID", "Balance"), "AccountID")


def _named(book, per_cust: DataFrame) -> DataFrame:
    """Names and types, joined after the grouping: only ids are shuffled, and
    the cleaned customers are bucketed on the id."""
    return per_cust.join(chain.customer_dim(book).select(*_CUST), "CustomerID")


def _dar(debt: Column, assets: Column) -> Column:
    return ratio4(debt, assets)


def debt_per_customer(book, n: int | None = TOP_N) -> DataFrame:
    """Q30: loans of any status, top customers by debt."""
    per_acct = chain.rollup_per_account(book.loan_rollup, _debt="p")
    out = _named(book, _accounts(book, per_acct).groupBy("CustomerID").agg(
        money(F.sum("_debt")).alias("TotalLoanDebt")
    )).select(*_CUST, "TotalLoanDebt")
    return _top(out, "TotalLoanDebt", n)


def assets_per_customer(book, n: int | None = TOP_N) -> DataFrame:
    """Q31: all accounts of a customer (no type join), top by balance."""
    per_cust = book.accounts.groupBy("CustomerID").agg(F.sum("Balance").alias("_bal"))
    c = chain.customer_dim(book, with_type=False).select("CustomerID", "CustomerName")
    out = per_cust.join(c, "CustomerID").groupBy("CustomerID", "CustomerName").agg(
        money(F.sum("_bal")).alias("TotalLiquidAssets")
    )
    return _top(out, "TotalLiquidAssets", n)


def liquidity_gap(book, n: int | None = TOP_N) -> DataFrame:
    """Q32."""
    d = _debt_and_assets(book, book.loan_rollup)
    out = d.select(
        *_CUST,
        money(F.col("_debt")).alias("TotalLoanDebt"),
        money(F.col("_assets")).alias("TotalLiquidAssets"),
        money(F.col("_debt") - F.col("_assets")).alias("LiquidityGap"),
    )
    return _top(out, "LiquidityGap", n)


def debt_to_asset_ratio(book, n: int | None = TOP_N) -> DataFrame:
    """Q33: DAR to 4 places, NULL ratios last."""
    d = _debt_and_assets(book, book.loan_rollup)
    out = d.select(
        *_CUST,
        money(F.col("_debt")).alias("TotalLoanDebt"),
        money(F.col("_assets")).alias("TotalLiquidAssets"),
        _dar(F.col("_debt"), F.col("_assets")).alias("DAR"),
    )
    return _top(out, "DAR", n)


def red_flag_list(book) -> DataFrame:
    """Q34: overdue loans only; the rounded DAR must exceed 1."""
    overdue = chain.rollup_with_status(book, only=STATUS_OVERDUE)
    d = _debt_and_assets(book, overdue)
    out = d.select(
        *_CUST,
        money(F.col("_debt")).alias("TotalLoanDebt"),
        money(F.col("_assets")).alias("TotalLiquidAssets"),
        _dar(F.col("_debt"), F.col("_assets")).alias("DAR"),
        money(F.col("_debt") - F.col("_assets")).alias("UncollateralizedDebt"),
    ).filter(F.col("DAR") > 1)
    return out.orderBy(F.col("UncollateralizedDebt").desc_nulls_last())


def vw_red_flag_customers(book, register: bool = False) -> DataFrame:
    """Q47: the red-flag view, read whole."""
    df = red_flag_list(book)
    if register:
        df.createOrReplaceTempView("vw_RedFlagCustomers")
    return df


def vw_red_flag_enterprise(book) -> DataFrame:
    """Q48."""
    return vw_red_flag_customers(book).filter(F.col("CustomerType") == LARGE_ENTERPRISE)


def vw_red_flag_top5(book) -> DataFrame:
    """Q49: the five largest uncollateralized debts (ties by CustomerID)."""
    return _top(vw_red_flag_customers(book), "UncollateralizedDebt", 5)
