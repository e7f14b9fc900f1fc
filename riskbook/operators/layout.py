"""Table layout in place of secondary indexes (stage 7, Q43).

A low-cardinality key (a status or type code, a month) becomes a directory,
so a filter on it prunes whole directories.  Files hold ranges of a composite
key: a filter on its first column skips files and row groups by parquet
min/max statistics, and a key that holds a third of the rows spans several
ranges through the second column.  A prepared Book writes the copies once, in
its load step; the queries here read them (``sources.book.LAYOUTS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_long, money

# The tables that the published index definitions covered (``sources.book.LAYOUTS``).
INDEXED = ("loans", "transactions_clean", "customers_final", "accounts")


def write_layouts(book) -> dict[str, DataFrame]:
    """The four tables the published index definitions covered, each in its
    layout (written at first use)."""
    return {name: book.clustered(name) for name in INDEXED}


def loans_by_status_clustered(book, status_id: int = 2) -> DataFrame:
    """Q40 over the loans layout: the status filter prunes to one directory."""
    return book.clustered("loans").filter(F.col("LoanStatusID") == status_id).select(
        "LoanID", "PrincipalAmount", "LoanStatusID")


def transactions_clustered(book) -> DataFrame:
    """Per month and origin account over the transactions layout: rows and
    volume (the month is a directory, the account the files' range)."""
    return book.clustered("transactions_clean").groupBy("TxMonth", "AccountOriginID").agg(
        count_long("*").alias("TxRows"), money(F.sum("Amount")).alias("TotalVolume"))


def customers_clustered(book) -> DataFrame:
    """Customers of each type over the customers layout."""
    return book.clustered("customers_final").groupBy("CustomerTypeID").agg(
        count_long("*").alias("Customers"), F.min("CustomerID").cast("long").alias("FirstCustomerID"),
        F.max("CustomerID").cast("long").alias("LastCustomerID"))


def accounts_clustered(book) -> DataFrame:
    """Accounts and balance of each customer over the accounts layout."""
    return book.clustered("accounts").groupBy("CustomerID").agg(
        count_long("*").alias("Accounts"), money(F.sum("Balance")).alias("TotalBalance"))
