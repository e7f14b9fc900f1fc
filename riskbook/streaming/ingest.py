"""Streaming form of the typed readers: append newly arrived files to a
role table exactly once.

The analysis is batch only (its snapshot tables are rebuilt from whole
tables), so nothing here changes a result: new transaction or loan files
dropped into a folder are read with the fixed schema (FAILFAST, never
inferred) and appended to the table folder the batch operators read.  The
file sink and its checkpoint (under ``spark.checkpoint.dir``) make each
file land once even if the job or an executor dies mid-way.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources import schemas


def read_stream(spark: SparkSession, name: str, source_dir: str, fmt: str = "csv",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving in ``source_dir`` as a stream with the role schema."""
    r = spark.readStream.schema(schemas.BY_NAME[name]).format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("mode", "FAILFAST").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def append_files(spark: SparkSession, name: str, source_dir: str, table_dir: str, fmt: str = "csv",
                 available_now: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Start the append stream; with ``available_now`` it processes what has
    arrived and stops (a scheduled incremental load)."""
    ckpt = checkpoint or scratch_path(spark, "streams", f"{name}-{os.path.basename(table_dir.rstrip('/'))}")
    w = (
        read_stream(spark, name, source_dir, fmt)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", table_dir)
        .option("checkpointLocation", ckpt)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
