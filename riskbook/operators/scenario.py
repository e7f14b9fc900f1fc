"""Interest-rate scenarios (stage 8b).

All scenarios of a report come out of one aggregate pass over the loan
rollup, statuses named in the scan stage: the yield at a shifted rate is the
yield plus the shift times the principal that has a rate.  Rate shifts are
exact decimals: a shift is rounded to 4 places as DECIMAL(5,4), and an
out-of-range shift raises (ANSI cast).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..plans import chain
from ..sources.lookups import STATUS_OVERDUE
from ..sources.schemas import RATE

# --- fixed values: the published scenario shifts ----------------------------
SHIFTS = {"Plus1Pct": Decimal("0.01"), "Plus2Pct": Decimal("0.02"),
          "Minus1Pct": Decimal("-0.01"), "Minus2Pct": Decimal("-0.02")}
# ---------------------------------------------------------------------------

def _yield_at(shift: Decimal | Column | None = None) -> Column:
    if shift is None:
        return F.sum("pr")
    s = shift if isinstance(shift, Column) else F.lit(shift)
    return F.sum("pr") + F.sum("p_rated") * s


def baseline_yield(book) -> DataFrame:
    """Q53."""
    return chain.rollup_with_status(book).groupBy("LoanStatus").agg(
        F.sum("ids").alias("TotalLoans"),
        money(F.sum("p")).alias("TotalPrincipal"),
        money(_yield_at()).alias("CurrentYield"),
    ).orderBy(F.col("TotalPrincipal").desc_nulls_last())


def rate_scenarios(book) -> DataFrame:
    """Q54: yield at the current rate and at each shift."""
    return chain.rollup_with_status(book).groupBy("LoanStatus").agg(
        money(_yield_at()).alias("CurrentYield"),
        money(_yield_at(SHIFTS["Minus1Pct"])).alias("Yield_Minus1Pct"),
        money(_yield_at(SHIFTS["Minus2Pct"])).alias("Yield_Minus2Pct"),
        money(_yield_at(SHIFTS["Plus1Pct"])).alias("Yield_Plus1Pct"),
        money(_yield_at(SHIFTS["Plus2Pct"])).alias("Yield_Plus2Pct"),
    ).orderBy("LoanStatus")


def rate_deltas(book) -> DataFrame:
    """Q55: scenario minus current yield, rounded once after subtracting."""
    cur = _yield_at()
    return chain.rollup_with_status(book).groupBy("LoanStatus").agg(
        money(cur).alias("CurrentYield"),
        *[money(_yield_at(SHIFTS[k]) - cur).alias(f"Delta_{k}")
          for k in ("Plus1Pct", "Plus2Pct", "Minus1Pct", "Minus2Pct")],
    ).orderBy("LoanStatus")


def overdue_ecl(book) -> DataFrame:
    """Q56: one row over overdue loans (no default-probability factor)."""
    return chain.rollup_with_status(book, only=STATUS_OVERDUE).agg(
        money(F.sum("p")).alias("OverduePrincipal"),
        money(_yield_at()).alias("ECL_CurrentRate"),
        *[money(_yield_at(SHIFTS[k])).alias(f"ECL_{k}")
          for k in ("Plus1Pct", "Plus2Pct", "Minus1Pct", "Minus2Pct")],
    )


def rate_shift_literal(shift) -> Column:
    """The shift as DECIMAL(5,4): rounded to 4 places, error if too large."""
    return F.lit(Decimal(str(shift))).cast(RATE.simpleString())


def what_if(book, rate_shift) -> DataFrame:
    """Q57: the portfolio at a shifted rate."""
    s = rate_shift_literal(rate_shift)
    cur, sim = _yield_at(), _yield_at(s)
    return chain.rollup_with_status(book).groupBy("LoanStatus").agg(
        F.sum("ids").alias("TotalLoans"),
        money(F.sum("p")).alias("TotalPrincipal"),
        money(cur).alias("CurrentYield"),
        money(sim).alias("SimulatedYield"),
        money(sim - cur).alias("YieldDelta"),
    )
