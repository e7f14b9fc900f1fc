"""Referential-integrity operators (stage 2).

An orphan is a child row whose key finds no parent row; a NULL key never
matches, so it is an orphan too.  Row lists are one anti join over one scan
of the child, in which hot and NULL keys are spread by a salt
(``plans.skew``).  Counts are one aggregate: children add up their rows per
key, parents mark theirs, and a key without a mark is an orphan's; a key
holding a third of the rows is one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import chain
from ..plans.skew import HotKeys, salted_join

# --- fixed values: relationship labels of the integrity summary -------------
REL_ACCOUNTS_CUSTOMERS = "accounts → customers"
REL_LOANS_ACCOUNTS = "loans → accounts"
REL_TX_ACCOUNTS = "transactions → accounts"
REL_TX_BRANCHES = "transactions → branches"
REL_LOANS_STATUSES = "loans → loan_statuses"
REL_CUSTOMERS_TYPES = "customers → customer_types"
INVALID_TYPE = "Invalid Type"
INVALID_STATUS = "Invalid Status"
VALID = "Valid"
# ---------------------------------------------------------------------------


def _parent_keys(parent: DataFrame, pk: str, fk: str) -> DataFrame:
    return parent.select(F.col(pk).alias(fk))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, keep: Sequence[str],
            hot: HotKeys | None = None) -> DataFrame:
    """Child rows with no parent row (NULL key included)."""
    child = child.select(*dict.fromkeys([*keep, fk]))
    return salted_join(child, _parent_keys(parent, pk, fk), fk, hot, "left_anti").select(*keep)


def orphan_accounts(book) -> DataFrame:
    """Q12: accounts whose customer is missing (raw customers)."""
    return orphans(book.accounts, "CustomerID", book.customers, "CustomerID", ["AccountID", "CustomerID"],
                   book.hot_keys("accounts.CustomerID"))


def orphan_loans(book) -> DataFrame:
    """Q13."""
    return orphans(book.loans, "AccountID", book.accounts, "AccountID", ["LoanID", "AccountID"],
                   book.hot_keys("loans.AccountID"))


def orphan_transactions_account(book) -> DataFrame:
    """Q14: origin account only; the destination is not checked."""
    return orphans(book.transactions_clean, "AccountOriginID", book.accounts, "AccountID",
                   ["TransactionID", "AccountOriginID"], book.hot_keys("transactions.AccountOriginID"))


def orphan_transactions_branch(book) -> DataFrame:
    """Q15."""
    return orphans(book.transactions_clean, "BranchID", book.branch_dim(), "BranchID",
                   ["TransactionID", "BranchID"], book.hot_keys("transactions.BranchID"))


def _code_orphans(book, child: DataFrame, key: str, table: str, keep: Sequence[str]) -> DataFrame:
    """Child rows whose code is not in the code table (NULL included)."""
    unknown = chain.code_unknown(book, table, key)
    if unknown is None:
        return orphans(child, key, book.code(table), key, keep)
    return child.filter(unknown).select(*keep)


def invalid_loan_status(book) -> DataFrame:
    """Q16."""
    return _code_orphans(book, book.loans, "LoanStatusID", "loan_statuses", ["LoanID", "LoanStatusID"])


def invalid_account_codes(book) -> DataFrame:
    """Q17: accounts failing either code table, each test labelled."""
    type_bad = chain.code_unknown(book, "account_types", "AccountTypeID")
    status_bad = chain.code_unknown(book, "account_statuses", "AccountStatusID")
    a = book.accounts
    if type_bad is None or status_bad is None:
        types = book.code("account_types").select("AccountTypeID", F.lit(True).alias("_type_ok"))
        stats = book.code("account_statuses").select("AccountStatusID", F.lit(True).alias("_status_ok"))
        a = a.join(types, "AccountTypeID", "left").join(stats, "AccountStatusID", "left")
        type_bad, status_bad = F.col("_type_ok").isNull(), F.col("_status_ok").isNull()
    return a.filter(type_bad | status_bad).select(
        "AccountID", "AccountTypeID", "AccountStatusID",
        F.when(type_bad, F.lit(INVALID_TYPE)).otherwise(F.lit(VALID)).alias("TypeCheck"),
        F.when(status_bad, F.lit(INVALID_STATUS)).otherwise(F.lit(VALID)).alias("StatusCheck"),
    )


def invalid_customer_type(book) -> DataFrame:
    """Q18 (cleaned customers)."""
    return _code_orphans(book, book.customers_final, "CustomerTypeID", "customer_types",
                         ["CustomerID", "CustomerTypeID"])


def _child(relationship: str, key: str, rows: Column) -> Column:
    """A child's entry: its rows under a key."""
    return F.struct(F.lit(relationship).alias("relationship"), F.col(key).cast("long").alias("key"),
                    rows.cast("long").alias("rows"), F.lit(None).cast("boolean").alias("known"))


def _parent(relationship: str, key: str) -> Column:
    """A parent's entry: its key is known."""
    return F.struct(F.lit(relationship).alias("relationship"), F.col(key).cast("long").alias("key"),
                    F.lit(0).cast("long").alias("rows"), F.lit(True).alias("known"))


def integrity_summary(book) -> DataFrame:
    """Q19: one row per relationship, zero counts kept.

    Every table is read once and gives all its entries, as child and as
    parent; one aggregate by (relationship, key) brings both together.  Loans
    come from the rollup.  A NULL key is never known."""
    one = F.lit(1)
    entries = [
        (book.accounts, [_child(REL_ACCOUNTS_CUSTOMERS, "CustomerID", one), _parent(REL_LOANS_ACCOUNTS, "AccountID"),
                         _parent(REL_TX_ACCOUNTS, "AccountID")]),
        (book.customers, [_parent(REL_ACCOUNTS_CUSTOMERS, "CustomerID")]),
        (book.loan_rollup, [_child(REL_LOANS_ACCOUNTS, "AccountID", F.col("rows")),
                            _child(REL_LOANS_STATUSES, "LoanStatusID", F.col("rows"))]),
        (book.transactions_clean, [_child(REL_TX_ACCOUNTS, "AccountOriginID", one),
                                   _child(REL_TX_BRANCHES, "BranchID", one)]),
        (book.branches, [_parent(REL_TX_BRANCHES, "BranchID")]),
        (book.customers_final, [_child(REL_CUSTOMERS_TYPES, "CustomerTypeID", one)]),
        (book.codes["loan_statuses"], [_parent(REL_LOANS_STATUSES, "LoanStatusID")]),
        (book.codes["customer_types"], [_parent(REL_CUSTOMERS_TYPES, "CustomerTypeID")]),
    ]
    parts = [df.select(F.explode(F.array(*arms)).alias("e")).select("e.*") if len(arms) > 1
             else df.select(arms[0].alias("e")).select("e.*") for df, arms in entries]
    every = reduce(DataFrame.unionByName, parts)
    keys = every.groupBy("relationship", "key").agg(F.sum("rows").alias("rows"), F.max("known").alias("known"))
    orphan = F.col("key").isNull() | F.col("known").isNull()
    found = keys.groupBy("relationship").agg(F.sum(F.when(orphan, F.col("rows"))).alias("orphan_count"))
    labels = [REL_ACCOUNTS_CUSTOMERS, REL_LOANS_ACCOUNTS, REL_TX_ACCOUNTS, REL_TX_BRANCHES, REL_LOANS_STATUSES,
              REL_CUSTOMERS_TYPES]
    named = book.spark.createDataFrame([(x,) for x in labels], "relationship string")
    return named.join(found, "relationship", "left").select(
        "relationship", F.coalesce("orphan_count", F.lit(0)).cast("long").alias("orphan_count"))
