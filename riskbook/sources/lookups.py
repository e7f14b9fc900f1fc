"""Code tables of the loan book.

These are fixed values: ids and names must equal the published code
tables so that status and segment names in every report match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schemas

# --- fixed values (id, name), in published order ---------------------------
LOAN_STATUSES = [(1, "Active"), (2, "Paid Off"), (3, "Overdue")]
CUSTOMER_TYPES = [(1, "Individual"), (2, "Small Business"), (3, "Large Enterprise")]
ACCOUNT_TYPES = [(1, "Checking"), (2, "Savings"), (3, "Payroll"), (4, "Business"), (5, "Youth")]
ACCOUNT_STATUSES = [(1, "Active"), (2, "Inactive"), (3, "Closed")]
TRANSACTION_TYPES = [(1, "Deposit"), (2, "Withdrawal"), (3, "Transfer"), (4, "Payment")]
# ---------------------------------------------------------------------------

STATUS_OVERDUE = "Overdue"
STATUS_PAID_OFF = "Paid Off"

FIXED = {
    "loan_statuses": LOAN_STATUSES,
    "customer_types": CUSTOMER_TYPES,
    "account_types": ACCOUNT_TYPES,
    "account_statuses": ACCOUNT_STATUSES,
    "transaction_types": TRANSACTION_TYPES,
}


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """A code table as a small in-plan relation (its size is the list above)."""
    return spark.createDataFrame(FIXED[name], schemas.BY_NAME[name])


def values_sql(name: str) -> str:
    """The same code table as a SQL VALUES list, for the SQL oracle."""
    cols = [f.name for f in schemas.BY_NAME[name].fields]
    rows = ", ".join(f"({i}, '{n}')" for i, n in FIXED[name])
    return f"SELECT * FROM (VALUES {rows}) AS v({cols[0]}, {cols[1]})"
