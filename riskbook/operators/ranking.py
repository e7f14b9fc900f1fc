"""Default-rate ranking of segments and branches (stage 6, view of 8a).

Ranks are windows over the aggregated rows (a handful of segments, at most
the branch count), never over loans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money, pct, safe_div
from ..plans import chain

TOP_BRANCHES = 20


def _segment_counts(book) -> DataFrame:
    """Per customer type: loans (with a known status) and overdue loans."""
    counted = chain.rollup_with_status(book).select(
        "AccountID", F.col("ids").alias("_n"), (chain.overdue_flag() * F.col("rows")).alias("_o"))
    return counted.join(chain.account_dim(book), "AccountID").groupBy("CustomerType").agg(
        F.sum("_n").cast("long").alias("TotalLoans"),
        F.sum("_o").cast("long").alias("OverdueLoans"),
    )


def segment_default_rate(book) -> DataFrame:
    """Q35."""
    s = _segment_counts(book)
    s = s.withColumn("DefaultRate_Pct", pct(F.col("OverdueLoans"), F.col("TotalLoans")))
    return s.orderBy(F.col("DefaultRate_Pct").desc_nulls_last())


def segment_rank(book) -> DataFrame:
    """Q36: RANK and DENSE_RANK over the rounded rate."""
    s = _segment_counts(book).withColumn(
        "DefaultRate_Pct", pct(F.col("OverdueLoans"), F.col("TotalLoans"))
    )
    w = Window.orderBy(F.col("DefaultRate_Pct").desc_nulls_last())
    return s.select(
        "CustomerType", "TotalLoans", "OverdueLoans", "DefaultRate_Pct",
        F.rank().over(w).cast("long").alias("RankByDefault"),
        F.dense_rank().over(w).cast("long").alias("DenseRankByDefault"),
    )


def vw_segment_rankings(book, register: bool = False) -> DataFrame:
    """Q50: RANK over the unrounded rate (ties differ from Q36)."""
    s = _segment_counts(book)
    raw = safe_div(F.col("OverdueLoans") * F.lit(Decimal("100.0")), F.col("TotalLoans"))
    w = Window.orderBy(raw.desc_nulls_last())
    df = s.select(
        "CustomerType", "TotalLoans", "OverdueLoans",
        money(raw).alias("DefaultRate_Pct"),
        F.rank().over(w).cast("long").alias("RiskRank"),
    )
    if register:
        df.createOrReplaceTempView("vw_SegmentRankings")
    return df


def branch_default_rank(book, n: int | None = TOP_BRANCHES) -> DataFrame:
    """Q37: per branch, loans counted once per (transaction, loan) pair.

    Pairs are never built: transactions reduce to (account, branch) -> t,
    loans to account -> (l, o); a branch's totals are sum(t*l), sum(t*o).
    Transactions must name an existing account (inner join to accounts).
    """
    tx = (
        book.transactions_clean.groupBy(F.col("AccountOriginID").alias("AccountID"), "BranchID")
        .agg(F.count(F.lit(1)).alias("_t"))
        .join(book.accounts.select("AccountID"), "AccountID", "left_semi")
    )
    loans = chain.rollup_per_account(chain.rollup_with_status(book), _l="ids",
                                     _o=chain.overdue_flag() * F.col("rows"))
    pairs = tx.join(loans, "AccountID").groupBy("BranchID").agg(
        F.sum(F.col("_t") * F.col("_l")).cast("long").alias("TotalLoans"),
        F.sum(F.col("_t") * F.col("_o")).cast("long").alias("OverdueLoans"),
    )
    b = book.branch_dim().select("BranchID", "BranchName")
    agg = pairs.join(b, "BranchID").withColumn(
        "DefaultRate_Pct", pct(F.col("OverdueLoans"), F.col("TotalLoans"))
    )
    w = Window.orderBy(F.col("DefaultRate_Pct").desc_nulls_last())
    out = agg.select(
        "BranchID", "BranchName", "TotalLoans", "OverdueLoans", "DefaultRate_Pct",
        F.rank().over(w).cast("long").alias("RiskRank"),
    ).orderBy("RiskRank", F.col("BranchID").asc_nulls_first())
    return out if n is None else out.limit(n)
