"""Session settings and the shared folder for materialized tables."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

def build_session(master: str = "local[8]", app: str = "riskbook", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and local runs (a cluster passes its own)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes of input per shuffle partition (and bucket): AQE coalesces small
# partitions at runtime and splits skewed joins.
_INPUT_PER_PARTITION = 256 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files under ``paths``, from their listing (any store that
    Spark reads; the contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.selectExpr("sum(length) AS n").first()["n"] or 0


def size_in_bytes(text: str) -> int:
    """The bytes that a size setting of Spark names ("128MB", "16m", "64b", "4096")."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings sized from the input: one initial shuffle partition per
    256 MB of input (at least one per core), AQE on with 128 MB target
    partitions so coalesced partitions fit executor memory, skew-join
    splitting on, and 256 MB scan splits.  Bucket counts follow the shuffle
    partitions (``plans.materialize``)."""
    parts = max(cores, -(-input_bytes // _INPUT_PER_PARTITION))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "256m",
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialized tables.

    Read from ``spark.checkpoint.dir``.  Only a local session (tests, a
    laptop) may fall back to a fresh temporary folder; a cluster must name a
    shared folder, since executors can be lost and a machine-local path
    would lose the written table with them.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for materialized tables")
    root = _LOCAL_ROOTS.get(sc.applicationId)
    if root is None:
        root = tempfile.mkdtemp(prefix="riskbook-ckpt-")
        _LOCAL_ROOTS[sc.applicationId] = root
        sc.setCheckpointDir(root)
    return root


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, *parts: str) -> str:
    app = spark.sparkContext.applicationId
    return os.path.join(checkpoint_root(spark), "riskbook", app, *parts)
