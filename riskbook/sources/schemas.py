"""Fixed schemas of the loan-book tables.

Keys are LongType so ids do not overflow at scale; money is DECIMAL(18,2)
and rates DECIMAL(5,4) so sums stay exact; timestamps carry no zone
(TimestampNTZType), which is how the input files store them.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(5, 4)
# Aggregated money and percentages: wide enough for sums over 100 TB.
MONEY_OUT = T.DecimalType(38, 2)
RATIO_OUT = T.DecimalType(38, 4)


def _fields(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


CUSTOMERS = _fields(
    ("CustomerID", T.LongType()),
    ("FirstName", T.StringType()),
    ("LastName", T.StringType()),
    ("DateOfBirth", T.DateType()),
    ("AddressID", T.LongType()),
    ("CustomerTypeID", T.IntegerType()),
)

ACCOUNTS = _fields(
    ("AccountID", T.LongType()),
    ("CustomerID", T.LongType()),
    ("AccountTypeID", T.IntegerType()),
    ("AccountStatusID", T.IntegerType()),
    ("Balance", MONEY),
)

LOANS = _fields(
    ("LoanID", T.LongType()),
    ("AccountID", T.LongType()),
    ("LoanStatusID", T.IntegerType()),
    ("PrincipalAmount", MONEY),
    ("InterestRate", RATE),
    ("StartDate", T.TimestampNTZType()),
    ("EstimatedEndDate", T.TimestampNTZType()),
)

TRANSACTIONS = _fields(
    ("TransactionID", T.LongType()),
    ("AccountOriginID", T.LongType()),
    ("AccountDestinationID", T.LongType()),
    ("TransactionTypeID", T.IntegerType()),
    ("Amount", MONEY),
    ("TransactionDate", T.TimestampNTZType()),
    ("BranchID", T.LongType()),
    ("Description", T.StringType()),
)

# Columns of the cleaned transaction table (no tie-break helper column).
TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]

BRANCHES = _fields(
    ("BranchID", T.LongType()),
    ("BranchName", T.StringType()),
    ("AddressID", T.LongType()),
)

CUSTOMER_TYPES = _fields(("CustomerTypeID", T.IntegerType()), ("TypeName", T.StringType()))
ACCOUNT_TYPES = _fields(("AccountTypeID", T.IntegerType()), ("TypeName", T.StringType()))
ACCOUNT_STATUSES = _fields(("AccountStatusID", T.IntegerType()), ("StatusName", T.StringType()))
LOAN_STATUSES = _fields(("LoanStatusID", T.IntegerType()), ("StatusName", T.StringType()))
TRANSACTION_TYPES = _fields(("TransactionTypeID", T.IntegerType()), ("TypeName", T.StringType()))

BY_NAME: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "accounts": ACCOUNTS,
    "loans": LOANS,
    "transactions": TRANSACTIONS,
    "branches": BRANCHES,
    "customer_types": CUSTOMER_TYPES,
    "account_types": ACCOUNT_TYPES,
    "account_statuses": ACCOUNT_STATUSES,
    "loan_statuses": LOAN_STATUSES,
    "transaction_types": TRANSACTION_TYPES,
}
