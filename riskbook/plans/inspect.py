"""Plan checks used by tests: read the physical plan text of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df: DataFrame) -> str:
    """The text ``df.explain("formatted")`` prints."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def has_cartesian(df: DataFrame) -> bool:
    p = physical_plan(df)
    return "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p


def count_exchanges(df: DataFrame) -> int:
    """Shuffle exchanges in the initial physical plan (before AQE re-plans)."""
    plan = physical_plan(df)
    return sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "rangepartitioning",
                                                          "SinglePartition", "RoundRobinPartitioning"))
