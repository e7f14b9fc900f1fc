"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import MONEY_OUT, RATIO_OUT


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_sum(cond: Column) -> Column:
    """SUM of a truth value: NULL over zero rows, NULL tests skipped."""
    return F.sum(cond.cast("int"))


def null_count(c: str | Column) -> Column:
    return flag_sum(col(c).isNull())


def blank_count(c: str | Column) -> Column:
    return flag_sum(col(c) == F.lit(""))


def clean_name(c: str | Column, placeholder: str = "Unknown") -> Column:
    """Trim spaces; empty or NULL becomes the placeholder."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(placeholder))


def full_name(first: str | Column, last: str | Column) -> Column:
    """First and last name joined by a space; NULL if either is NULL."""
    return F.concat(col(first), F.lit(" "), col(last))


def bucketize(c: str | Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Label by the first edge the value is below; the last label otherwise
    (a NULL value also takes the last label)."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    x = col(c)
    expr = None
    for edge, label in zip(edges, labels):
        cond = x < F.lit(edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


# Casts by type name: one call to the JVM instead of a type-object round trip.
_MONEY_OUT = MONEY_OUT.simpleString()
_RATIO_OUT = RATIO_OUT.simpleString()


def money(c: Column) -> Column:
    """Round to cents (half up) as DECIMAL(38,2)."""
    return F.round(c, 2).cast(_MONEY_OUT)


def ratio4(num: Column, den: Column) -> Column:
    """num / den rounded to 4 places (half up), NULL when den is 0.

    Money operands are first narrowed to DECIMAL(24,2) (sums up to 1e22):
    two DECIMAL(38,2) operands would give a quotient with only 6 places,
    rounded before the final rounding to 4 (14.29174995 -> 14.291750 ->
    14.2918).  Narrowed, the quotient keeps 14 places.
    """
    q = safe_div(num.cast(_RATIO_OPERAND), den.cast(_RATIO_OPERAND))
    return F.round(q, 4).cast(_RATIO_OUT)


_RATIO_OPERAND = T.DecimalType(24, 2).simpleString()


def safe_div(num: Column, den: Column) -> Column:
    """num / den with a zero denominator giving NULL instead of an error."""
    return num / F.nullif(den, F.lit(0))


# Operand that leaves a mean 16 places (sums up to 1e22), so it is rounded once.
_MEAN_OPERAND = T.DecimalType(26, 4).simpleString()


def mean2(total: Column, count: Column) -> Column:
    """total / count rounded to cents (half up), NULL when nothing counts."""
    return money(safe_div(total.cast(_MEAN_OPERAND), count))


def pct(part: Column, whole: Column) -> Column:
    """part * 100 / whole, rounded to 2 places; NULL when whole is 0."""
    return money(safe_div(part * F.lit(Decimal("100.0")), whole))


def month_key(c: str | Column) -> Column:
    """'yyyy-MM' text of a timestamp; NULL stays NULL."""
    return F.date_format(col(c), "yyyy-MM")


def ts_literal(value: str) -> Column:
    """A zone-less timestamp literal, comparable with TIMESTAMP_NTZ columns."""
    return F.lit(str(value)).cast("timestamp_ntz")


def count_long(c: str | Column = "*") -> Column:
    return F.count(c if c == "*" else col(c)).cast("long")
