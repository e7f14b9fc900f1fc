"""Property tests: the column helpers against plain Python statements of
the same rules, on generated values (one Spark job per generated list)."""

from __future__ import annotations

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from riskbook.functions.columns import bucketize, clean_name, ratio4
from riskbook.operators.quality import RISK_EDGES, RISK_LABELS

RATES = st.one_of(st.none(), st.integers(min_value=0, max_value=2000).map(lambda n: Decimal(n).scaleb(-4)))
NAMES = st.one_of(st.none(), st.text(alphabet=" \tab", max_size=6))


def risk_label(rate):
    if rate is not None and rate < RISK_EDGES[0]:
        return RISK_LABELS[0]
    if rate is not None and rate < RISK_EDGES[1]:
        return RISK_LABELS[1]
    return RISK_LABELS[2]


def cleaned(name):
    if name is None or name.strip(" ") == "":
        return "Unknown"
    return name.strip(" ")


@settings(max_examples=4, deadline=None)
@given(st.lists(RATES, min_size=1, max_size=200))
def test_bucketize_matches_rule(spark, rates):
    df = spark.createDataFrame([(r,) for r in rates], T.StructType([T.StructField("r", T.DecimalType(5, 4))]))
    got = [row[0] for row in df.select(bucketize("r", RISK_EDGES, RISK_LABELS)).collect()]
    assert got == [risk_label(r) for r in rates]


@settings(max_examples=4, deadline=None)
@given(st.lists(NAMES, min_size=1, max_size=200))
def test_clean_name_trims_spaces_only(spark, names):
    df = spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField("n", T.StringType())]))
    got = [row[0] for row in df.select(clean_name("n")).collect()]
    assert got == [cleaned(n) for n in names]


MONEY = st.integers(min_value=-10**12, max_value=10**12).map(lambda n: Decimal(n).scaleb(-2))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(MONEY, MONEY), min_size=1, max_size=100))
def test_ratio_rounds_once_half_up(spark, pairs):
    schema = T.StructType([T.StructField("a", T.DecimalType(18, 2)), T.StructField("b", T.DecimalType(18, 2))])
    df = spark.createDataFrame(pairs, schema)
    got = [row[0] for row in df.select(ratio4(df["a"], df["b"])).collect()]
    want = []
    for a, b in pairs:
        if b == 0:
            want.append(None)
            continue
        q = abs(a) / abs(b)   # exact enough at 28 digits to round once, half up, at 4 places
        r = q.quantize(Decimal("0.0001"), rounding="ROUND_HALF_UP")
        want.append(r if (a >= 0) == (b > 0) or r == 0 else -r)
    assert got == want
