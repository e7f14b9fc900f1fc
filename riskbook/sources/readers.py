"""Typed readers for the loan-book tables (operators S1, S2).

Schemas are always given, never inferred: CSV inference would turn money
into DOUBLE, and an empty file would read as a schema-less frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# File names of the published loan-book CSV tables.
CSV_TABLES = [
    "account_statuses",
    "account_types",
    "branches",
    "customer_types",
    "loan_statuses",
    "loans",
    "transaction_types",
    "transactions",
]


def read_csv_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """S1: a header CSV file as a typed table (FAILFAST on malformed rows)."""
    return (
        spark.read.schema(schemas.BY_NAME[name])
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(path)
    )


def read_parquet_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """S2: a parquet table projected and cast onto the fixed schema."""
    schema = schemas.BY_NAME[name]
    df = spark.read.parquet(path)
    return df.select([F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return read_csv_table(spark, name, path)
    return read_parquet_table(spark, name, path)


def read_csv_dir(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The published CSV tables under ``data_dir``; a missing one is an error."""
    return {name: read_csv_table(spark, name, f"{data_dir.rstrip('/')}/{name}.csv") for name in CSV_TABLES}
