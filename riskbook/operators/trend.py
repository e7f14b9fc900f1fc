"""Monthly trends and top accounts (stages 6 and 7).

Every window here runs over monthly aggregates (a few hundred rows at
most per century), so its single-partition sort is cheap at any scale.
A NULL month is its own group and sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_long, money, month_key, ts_literal

TOP_ACCOUNTS = 20


def monthly_volume_trend(tx: DataFrame, date_col: str = "TransactionDate", amount_col: str = "Amount",
                         id_col: str = "TransactionID", month=None) -> DataFrame:
    """Q38: per month count and volume, previous and next volume, change
    (``month``: a column that already holds the month)."""
    m = tx.groupBy((month_key(date_col) if month is None else month).alias("TxMonth")).agg(
        count_long(id_col).alias("TxCount"),
        money(F.sum(amount_col)).alias("TotalVolume"),
    )
    return _with_neighbours(m)


def _with_neighbours(m: DataFrame) -> DataFrame:
    """Monthly totals with the volume of the months before and after."""
    w = Window.orderBy(F.col("TxMonth").asc_nulls_first())
    prev = F.lag("TotalVolume").over(w)
    return m.select(
        "TxMonth", "TxCount", "TotalVolume",
        prev.alias("PrevMonthVolume"),
        F.lead("TotalVolume").over(w).alias("NextMonthVolume"),
        money(F.col("TotalVolume") - prev).alias("MoM_Change"),
    ).orderBy(F.col("TxMonth").asc_nulls_first())


def monthly_transaction_trend(book) -> DataFrame:
    """Q38 over the cleaned transactions, from their rollup by month."""
    return _with_neighbours(book.tx_months.groupBy("TxMonth").agg(
        F.sum("tx_ids").alias("TxCount"), money(F.sum("tx_volume")).alias("TotalVolume")))


def running_exposure(book) -> DataFrame:
    """Q39: monthly principal by start month and its running total."""
    m = book.loans.groupBy(month_key("StartDate").alias("LoanMonth")).agg(
        F.sum("PrincipalAmount").alias("_p")
    )
    w = Window.orderBy(F.col("LoanMonth").asc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return m.select(
        "LoanMonth",
        money(F.col("_p")).alias("MonthlyExposure"),
        money(F.sum("_p").over(w)).alias("RunningTotalExposure"),
    ).orderBy(F.col("LoanMonth").asc_nulls_first())


def top_accounts_by_volume(book, since: str = "2023-01-01", n: int | None = TOP_ACCOUNTS) -> DataFrame:
    """Q41: transactions since a date, top origin accounts by volume.  Whole
    months come from the rollup; of the transactions only the month that the
    date cuts is read (the filters prune the other directories)."""
    first = month_key(ts_literal(since))
    cut = book.transactions_by_month.filter(
        (F.col("TxMonth") == first) & (F.col("TransactionDate") >= ts_literal(since))).groupBy("AccountOriginID").agg(
        F.count("TransactionID").alias("tx_ids"), F.sum("Amount").alias("tx_volume"))
    whole = book.tx_months.filter(F.col("TxMonth") > first).select("AccountOriginID", "tx_ids", "tx_volume")
    out = cut.unionByName(whole).groupBy("AccountOriginID").agg(
        F.sum("tx_ids").alias("TxCount"),
        money(F.sum("tx_volume")).alias("TotalVolume"),
    ).orderBy(F.col("TotalVolume").desc_nulls_last(), F.col("AccountOriginID").asc_nulls_first())
    return out if n is None else out.limit(n)
