"""Tables written once and read back (cuts lineage).

A ``Store`` is a catalog database of its own whose folder lies under the
shared folder named by ``spark.checkpoint.dir``: a lost executor costs a
re-read of written files, not a replay of the plan, and ``drop`` removes
tables and files together.  ``localCheckpoint`` is never used.

All bucketed tables of a store have one bucket count, so a join or aggregate
on the bucket key reads the buckets where they are: as many as the session
has shuffle partitions, and more if the input is so large that the rows of a
bucket would not fit a task's memory.  Rows are dealt by the key before a
bucketed write, which gives one file a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import input_bytes, scratch_path, shuffle_partitions, size_in_bytes

# A task that builds a bucketed table gets so many bytes: of input per bucket,
# of files per scan, of shuffled rows per aggregate.  Rows with eight sums take
# ten times their input in memory, so these stay in a task's share of an
# executor, and nothing is spilled, whatever the size of the input.
INPUT_PER_BUCKET = 16 * 1024 * 1024
SMALL_TASKS = {"spark.sql.files.maxPartitionBytes": 8 * 1024 * 1024,
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 * 1024 * 1024}


class Store:
    def __init__(self, spark: SparkSession, name: str | None = None, inputs: Sequence[str] = ()) -> None:
        """``name``: a lasting database to write to (created if missing);
        without one a scratch database is made, for ``drop`` to remove.
        ``inputs``: the files that the tables come from, for their size."""
        self.spark = spark
        self.inputs = list(inputs)
        self._least_buckets: int | None = None
        self.name = name or f"riskbook_{uuid.uuid4().hex[:12]}"
        place = "" if name else f" LOCATION '{scratch_path(spark, self.name)}'"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name}{place}")

    def _save(self, writer, table: str, columns: list[str]) -> DataFrame:
        writer.mode("overwrite").format("parquet").saveAsTable(f"{self.name}.{table}")
        return self.table(table).select(*columns)

    def table(self, table: str) -> DataFrame:
        """A written table as it is now."""
        return self.spark.table(f"{self.name}.{table}")

    def plain(self, df: DataFrame, table: str) -> DataFrame:
        return self._save(df.write, table, df.columns)

    def buckets(self) -> int:
        """The bucket count: one per shuffle partition, and at least one per
        ``INPUT_PER_BUCKET`` of input (found once, from the file listing)."""
        if self._least_buckets is None:
            size = input_bytes(self.spark, self.inputs) if self.inputs else 0
            self._least_buckets = -(-size // INPUT_PER_BUCKET)
        return max(shuffle_partitions(self.spark), self._least_buckets)

    @contextmanager
    def _small_tasks(self, partitions: int) -> Iterator[None]:
        """Shuffles into ``partitions`` and tasks of at most ``SMALL_TASKS``
        bytes while a table is written."""
        conf = self.spark.conf
        before = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", *SMALL_TASKS)}
        try:
            conf.set("spark.sql.shuffle.partitions", str(partitions))
            for k, most in SMALL_TASKS.items():
                conf.set(k, f"{min(most, size_in_bytes(before[k]))}b")
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def bucketed(self, df: DataFrame, table: str, key: str) -> DataFrame:
        """One row per ``key`` (a dimension): bucketed and sorted on it."""
        n = self.buckets()
        with self._small_tasks(n):
            return self._save(df.repartition(n, key).write.bucketBy(n, key).sortBy(key), table, df.columns)

    def append_bucketed(self, df: DataFrame, table: str, key: str) -> None:
        """More rows for a table that ``bucketed`` wrote."""
        n, columns = self.buckets(), self.table(table).columns
        writer = df.select(*columns).repartition(n, key).write.bucketBy(n, key).sortBy(key)
        writer.mode("append").format("parquet").saveAsTable(f"{self.name}.{table}")

    def overwrite_directories(self, df: DataFrame, table: str, directories: Sequence[str], keys: Sequence[str]) -> None:
        """Replace the directories of a ``layout`` table that ``df`` has rows
        for; the others stay as they are."""
        columns = [*directories, *keys]
        spread = df.select(*self.table(table).columns).repartitionByRange(shuffle_partitions(self.spark), *columns)
        mode = "spark.sql.sources.partitionOverwriteMode"          # insertInto reads it from the session alone
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            spread.sortWithinPartitions(*columns).write.insertInto(f"{self.name}.{table}", overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def layout(self, df: DataFrame, table: str, directories: Sequence[str], keys: Sequence[str]) -> DataFrame:
        """Directories for low-cardinality columns, and files that each hold
        one range of ``directories`` and ``keys`` together: filters on the
        first key skip files, a key or directory that holds a third of the
        rows spans several ranges, and there are at most as many files as
        partitions and directories together."""
        columns = [*directories, *keys]
        spread = df.repartitionByRange(shuffle_partitions(self.spark), *columns)
        writer = spread.sortWithinPartitions(*columns).write
        return self._save(writer.partitionBy(*directories) if directories else writer, table, df.columns)

    def file_ranges(self, table: str, key: str) -> DataFrame:
        """``file``, ``lo``, ``hi``: the range of ``key`` in each file of a
        written table, kept as ``<table>_files``.  A filter on
        ``_metadata.file_path`` then leaves the other files unopened."""
        ranges = self.spark.table(f"{self.name}.{table}").groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(key).alias("lo"), F.max(key).alias("hi"))
        return self.plain(ranges, f"{table}_files")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


def merge_first(store: Store, table: str, new: DataFrame, key: str, order_by: Sequence[str],
                layout: tuple[Sequence[str], Sequence[str]], arrival_decides: bool, count_col: str = "Copies") -> None:
    """Merge ``new`` (one row per ``key``, its rows counted in ``count_col``)
    into a written table of the same form, keeping the first row of each key.

    First is the smallest by ``order_by`` (NULL first), then an old row before
    a new one if ``arrival_decides``, then the other columns.  A directory is
    written again if a row of it has a key of ``new`` or ends up there; one
    that loses its last row is dropped.  NULL is a key like any other.
    """
    directories, keys = layout
    (directory,) = directories
    stored, fields = store.table(table), [c for c in new.columns if c not in (key, count_col, directory)]
    new = store.plain(new, f"{table}_new")
    same = stored[key].eqNullSafe(new[key])
    replaced = stored.join(new, same, "left_semi")
    both = replaced.withColumn("_arrival", F.lit(0)).unionByName(new.withColumn("_arrival", F.lit(1)))
    arrival = ["_arrival"] if arrival_decides else []
    rank = [*order_by, *arrival, *[c for c in fields if c not in order_by], directory]
    first = both.groupBy(key).agg(F.min(F.struct(*rank)).alias("_first"), F.sum(count_col).alias(count_col))
    merged = store.plain(first.select(key, count_col, *[F.col("_first")[c].alias(c) for c in [*fields, directory]]),
                         f"{table}_merged")
    touched = {r[0] for r in replaced.select(directory).unionByName(merged.select(directory)).distinct().collect()}
    in_touched = F.coalesce(F.col(directory), F.lit("")).isin([d or "" for d in touched])
    rest = stored.filter(in_touched).join(new, same, "left_anti")
    after = store.plain(rest.unionByName(merged), f"{table}_touched")       # written apart before anything is replaced
    left = {r[0] for r in after.select(directory).distinct().collect()}
    store.overwrite_directories(after, table, directories, keys)
    for gone in touched - left:
        value = "NULL" if gone is None else "'" + gone.replace("'", "\\'") + "'"
        store.spark.sql(f"ALTER TABLE {store.name}.{table} DROP IF EXISTS PARTITION ({directory} = {value})")
    store.spark.catalog.refreshTable(f"{store.name}.{table}")
