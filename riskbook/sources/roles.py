"""Map the generated TPC-H-like tables onto the loan-book roles.

The generated data is clean, so defects (NULL and blank names, unknown
codes, orphan keys, repeated ids, end dates before start dates) are
injected by fixed key arithmetic.  The expressions only derive columns:
every input row is kept, so the work of every query grows with the data.

    customers     <- customer   (one row per c_custkey)
    accounts      <- orders     (one row per o_orderkey)
    loans         <- lineitem   (one row per line)
    transactions  <- events     (one row per event)
    branches      <- part       (one row per part)

The SQL form of the same mapping lives in ``riskbook.oracle``; both were
run side by side and give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Transactions point at the first 50 branches (the published branch table
# has 50 rows); three of every 53 point at branch -1, which does not exist.
N_BRANCHES = 50
BRANCH_MODULUS = 53


def _key_hits(col: str, modulus: int) -> Column:
    return (F.col(col) % modulus) == 0


def _cast_all(df: DataFrame, schema, extra: tuple[str, ...] = ()) -> DataFrame:
    cols = [F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    return df.select(*cols, *extra)


def customers(customer: DataFrame) -> DataFrame:
    first = (
        F.when(_key_hits("c_custkey", 97), F.lit(None).cast("string"))
        .when(_key_hits("c_custkey", 89), F.lit(""))
        .when(_key_hits("c_custkey", 83), F.lit("   "))
        .otherwise(F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)))
    )
    last = F.when(_key_hits("c_custkey", 79), F.lit("")).otherwise(
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))
    )
    dob = F.when(_key_hits("c_custkey", 61), F.lit(None).cast("date")).otherwise(
        F.lit("1950-01-01").cast("date")
    )
    ctype = (
        F.when(_key_hits("c_custkey", 71), F.lit(99))
        .when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), F.lit(1))
        .when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), F.lit(2))
        .otherwise(F.lit(3))
    )
    out = customer.select(
        F.col("c_custkey").alias("CustomerID"),
        first.alias("FirstName"),
        last.alias("LastName"),
        dob.alias("DateOfBirth"),
        F.col("c_nationkey").alias("AddressID"),
        ctype.alias("CustomerTypeID"),
    )
    return _cast_all(out, schemas.CUSTOMERS)


def accounts(orders: DataFrame) -> DataFrame:
    out = orders.select(
        F.col("o_orderkey").alias("AccountID"),
        F.when(_key_hits("o_orderkey", 101), F.lit(-1)).otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.when(_key_hits("o_orderkey", 401), F.lit(9))
        .otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
        .alias("AccountTypeID"),
        F.when(_key_hits("o_orderkey", 307), F.lit(9))
        .when(F.col("o_orderstatus") == "F", F.lit(1))
        .when(F.col("o_orderstatus") == "O", F.lit(2))
        .otherwise(F.lit(3))
        .alias("AccountStatusID"),
        F.when(_key_hits("o_orderkey", 4), F.col("o_totalprice").cast(schemas.MONEY))
        .otherwise(F.lit(0).cast(schemas.MONEY))
        .alias("Balance"),
    )
    return _cast_all(out, schemas.ACCOUNTS)


def loans(lineitem: DataFrame) -> DataFrame:
    ship = F.col("l_shipdate")
    out = lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("LoanID"),
        F.when(_key_hits("l_partkey", 503), F.lit(-1)).otherwise(F.col("l_orderkey")).alias("AccountID"),
        F.when(_key_hits("l_suppkey", 97), F.lit(9))
        .when(F.col("l_returnflag") == "N", F.lit(1))
        .when(F.col("l_returnflag") == "A", F.lit(2))
        .otherwise(F.lit(3))
        .alias("LoanStatusID"),
        F.col("l_extendedprice").cast(schemas.MONEY).alias("PrincipalAmount"),
        F.col("l_discount").cast(schemas.RATE).alias("InterestRate"),
        F.when(_key_hits("l_partkey", 61), F.lit(None)).otherwise(ship).alias("StartDate"),
        F.when(_key_hits("l_partkey", 67), ship - F.expr("INTERVAL 30 DAYS"))
        .otherwise(ship + F.expr("INTERVAL 730 DAYS"))
        .alias("EstimatedEndDate"),
    )
    return _cast_all(out, schemas.LOANS)


def transactions(events: DataFrame) -> DataFrame:
    """Transactions with an extra ``SourceRow`` column (the event id), a
    unique tie-breaker for keep-first de-duplication."""
    eid = F.col("event_id")
    ttype = (
        F.when(F.col("event_type") == "signup", F.lit(1))
        .when(F.col("event_type") == "view", F.lit(2))
        .when(F.col("event_type") == "click", F.lit(3))
        .when(F.col("event_type") == "purchase", F.lit(4))
        .otherwise(F.lit(9))
    )
    out = events.select(
        F.when(eid % 50 == 1, eid - 1).otherwise(eid).alias("TransactionID"),
        F.when(eid % 211 == 0, F.lit(-1)).otherwise(F.col("user_id") * 10 + eid % 10).alias("AccountOriginID"),
        (F.col("user_id") * 10 + (eid + 3) % 10).alias("AccountDestinationID"),
        ttype.alias("TransactionTypeID"),
        F.col("value").cast(schemas.MONEY).alias("Amount"),
        F.col("ts").alias("TransactionDate"),
        F.when(eid % BRANCH_MODULUS >= N_BRANCHES, F.lit(-1)).otherwise(eid % BRANCH_MODULUS + 1).alias("BranchID"),
        F.col("props").alias("Description"),
        eid.alias("SourceRow"),
    )
    return _cast_all(out, schemas.TRANSACTIONS, extra=("SourceRow",))


def branches(part: DataFrame) -> DataFrame:
    bid = F.col("p_partkey") + 1
    out = part.select(
        bid.alias("BranchID"),
        F.concat(F.lit("Branch "), bid.cast("string")).alias("BranchName"),
        F.col("p_size").alias("AddressID"),
    )
    return _cast_all(out, schemas.BRANCHES)


def driver_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def input_paths(sf_dir: str) -> list[str]:
    """The generated tables that the role mapping reads."""
    return [driver_path(sf_dir, name) for name in ("customer", "orders", "lineitem", "events", "part")]


def read_driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def rd(name: str) -> DataFrame:
        return spark.read.parquet(driver_path(sf_dir, name))

    return {
        "customers": customers(rd("customer")),
        "accounts": accounts(rd("orders")),
        "loans": loans(rd("lineitem")),
        "transactions": transactions(rd("events")),
        "branches": branches(rd("part")),
    }
