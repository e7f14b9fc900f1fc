"""Hot keys: find them once, then spread their rows.

A key may hold a large share of a fact table (one account with a third of
all loans, or rows without a key).  Aggregates are safe, since the partial
aggregate before the shuffle reduces a hot key to one row per task.
Row-level joins are not: every row of the key would meet in one task.

``salted_join`` reads the fact once and shuffles it once.  Each row gets a
salt next to its key: 0 for ordinary keys, one of the key's fan-out for a
hot key, and one of the NULL rows' fan-out for a NULL key (which matches
nothing, so its rows only have to be kept apart).  The dimension's rows of
hot keys are repeated once per salt.  ``split_join`` is the older form for
facts that are cheap to read twice: hot keys join a broadcast slice.

A key is hot if it holds more rows than an even shuffle partition would.
There are fewer such keys than partitions whatever the data, which bounds
the map from key to fan-out (one row per hot key) without a cap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions


@dataclass
class HotKeys:
    keys: DataFrame     # the hot key values (never NULL) and their fan-out, ``_fan``
    count: int
    null_fan: int = 1   # tasks that rows without a key are spread over

    def __bool__(self) -> bool:
        return self.count > 0 or self.null_fan > 1


SALT = "_salt"


def find_hot_keys(df: DataFrame, key: str, min_rows: int | None = None, store=None, name: str = "") -> HotKeys:
    """Keys with more than ``min_rows`` rows (default: an even share of a
    shuffle partition), by a partial aggregate.  ``store`` writes the list
    once as ``hot_<name>``, so queries that use it do not aggregate the fact
    again."""
    if min_rows is None:
        min_rows = max(1, df.count() // shuffle_partitions(df.sparkSession))
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > min_rows)
        .select(key, F.ceil(F.col("_rows") / min_rows).cast("int").alias("_fan"))
    )
    if store is not None:
        hot = store.plain(hot, f"hot_{name or key}")
    found = hot.agg(F.count(key).alias("n"), F.max(F.when(F.col(key).isNull(), F.col("_fan"))).alias("null")).first()
    return HotKeys(hot.filter(F.col(key).isNotNull()), found["n"], found["null"] or 1)


def salted_join(fact: DataFrame, dim: DataFrame, key: str, hot: HotKeys | None, how: str = "inner",
                then: Callable[[DataFrame, list[str]], DataFrame] | None = None,
                spread_by: Sequence[str] = ()) -> DataFrame:
    """``then(fact.join(dim, key, how), [])`` with the rows of hot and NULL
    keys spread over tasks, in one scan and one shuffle of the fact.

    ``how`` is "inner", "left", "left_semi" or "left_anti".  ``then`` (default:
    nothing) gets the joined rows and the column that has to be among its
    grouping keys if it aggregates by ``key`` and others: the join leaves the
    rows partitioned by both, so such an aggregate needs no second shuffle.
    Then ``spread_by`` must name fact columns it groups by, so that rows of
    one group share a salt.
    """
    step = then or (lambda df, more: df)
    if not hot:
        return step(fact.join(dim, key, how), [])
    fans = F.broadcast(hot.keys.withColumnRenamed(key, "_hot"))
    place = F.xxhash64(*spread_by) if spread_by else F.monotonically_increasing_id()

    def fanned(df: DataFrame, null_fan: int) -> tuple[DataFrame, Column]:
        found = df.join(fans, F.col(key) == F.col("_hot"), "left")
        return found, F.when(F.col(key).isNull(), F.lit(null_fan)).otherwise(F.coalesce("_fan", F.lit(1)))

    rows, fan = fanned(fact, hot.null_fan)
    salted = rows.withColumn(SALT, F.pmod(place, fan.cast("long")).cast("int")).drop("_hot", "_fan")
    copies, fan = fanned(dim, 1)
    repeated = copies.withColumn(SALT, F.explode(F.sequence(F.lit(0), fan - 1))).drop("_hot", "_fan")
    out = step(salted.join(repeated, [key, SALT], how), [SALT])
    return out.drop(SALT)


def split_join(fact: DataFrame, dim: DataFrame, key: str, hot: HotKeys | None, how: str = "inner",
               then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``then(fact.join(dim, key, how))`` with hot keys joined by broadcast.

    ``dim`` must hold one row per key (for a semi or anti join, repeats only
    widen the slice).  ``how`` is "inner", "left", "left_semi" or "left_anti".
    ``then`` (default: nothing) is applied to each part before the union; it
    must keep rows of different keys apart, as an aggregate grouped by ``key``
    (among others) does.  The shuffle join leaves its part partitioned by
    ``key``, so such an aggregate needs no second shuffle.
    """
    step = then or (lambda df: df)
    if hot is None or hot.count == 0:
        return step(fact.join(dim, key, how))
    hk = F.broadcast(hot.keys)
    hot_fact = fact.join(hk, key, "left_semi")
    cold_fact = fact.join(hk, key, "left_anti")
    dim_hot = F.broadcast(dim.join(hk, key, "left_semi"))
    return step(cold_fact.join(dim, key, how)).unionByName(step(hot_fact.join(dim_hot, key, how)))
