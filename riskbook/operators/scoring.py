"""Credit health score per customer (stage 8a), set-based for all customers.

Score = 50 * paid-off + 0.1 * distinct transactions - 30 * overdue, where
the paid-off and overdue counts are taken over the loan x transaction
outer join of the analysis: each loan row weighs max(n, 1), n being the
transaction rows of its account.  The loan and transaction totals are
distinct counts.  The fan-out itself is never built:

* per account: transaction rows n and ids k, kept by the Book (ids are
  unique after the de-duplication, and each id belongs to one account);
* loans are read once and joined to their account once; two grouping sets
  then give, per (customer, loan id), the weighted paid-off and overdue sums,
  and per (customer, account), its k once;
* per customer: sums of both.  Grouping by the loan id first spreads a
  customer holding many loans over all tasks.

One customer's call looks the customer's accounts up in the accounts layout
and reads the loan files, account buckets and transaction buckets that hold
them; a customer with very many accounts is answered by semi joins.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..plans import chain

# --- fixed values: score weights -------------------------------------------
PAID_OFF_POINTS = 50
TRANSACTION_POINTS = Decimal("0.1")
OVERDUE_POINTS = 30
# ---------------------------------------------------------------------------


def credit_health_score(book, customer_id: int | None = None) -> DataFrame:
    """Q51 (``customer_id`` keeps one customer, as the stored call did)."""
    own = None if customer_id is None else book.accounts_of(customer_id)
    acct = chain.account_dim(book).select("AccountID", "CustomerID")
    who = chain.customer_dim(book).select("CustomerID", "CustomerName", "CustomerType")
    tx = chain.tx_per_account(book).select("AccountID", "tx_rows", "tx_ids")
    loans = chain.loans_with_status(book, rows=None if own is None else book.loans_of(own)).select(
        "AccountID", "LoanID",
        chain.paid_off_flag().alias("_paid"), chain.overdue_flag().alias("_over"),
    )
    if customer_id is not None:
        acct = acct.filter(F.col("CustomerID") == customer_id)
        who = who.filter(F.col("CustomerID") == customer_id)
        if own is None:
            keys = acct.select("AccountID").distinct()
            loans, tx = loans.join(keys, "AccountID", "left_semi"), tx.join(keys, "AccountID", "left_semi")
        else:
            acct, tx = (df.filter(F.col("AccountID").isin(own)) for df in (acct, tx))

    acct = acct.join(tx, "AccountID", "left")
    rows = chain.join_accounts(book, loans, acct) if own is None else loans.join(acct, "AccountID")
    weight = F.greatest(F.coalesce(F.col("tx_rows"), F.lit(0)), F.lit(1))
    by_loan = (F.grouping_id() == 1)                     # (customer, loan id); else (customer, account)
    sets = rows.select("CustomerID", "LoanID", "AccountID", "tx_ids", (F.col("_paid") * weight).alias("_paid"),
                       (F.col("_over") * weight).alias("_over")).groupingSets(
        [[F.col("CustomerID"), F.col("LoanID")], [F.col("CustomerID"), F.col("AccountID")]],
        "CustomerID", "LoanID", "AccountID").agg(
        by_loan.alias("_by_loan"), F.sum("_paid").alias("_paid"), F.sum("_over").alias("_over"),
        F.max("tx_ids").alias("_k"))
    per_cust = sets.groupBy("CustomerID").agg(
        F.count(F.when(F.col("_by_loan"), F.col("LoanID"))).alias("TotalLoans"),
        F.sum(F.when(F.col("_by_loan"), F.col("_paid"))).alias("PaidOffLoans"),
        F.sum(F.when(F.col("_by_loan"), F.col("_over"))).alias("OverdueLoans"),
        F.sum(F.when(~F.col("_by_loan"), F.col("_k"))).alias("_k"),
    )
    k = F.coalesce(F.col("_k"), F.lit(0)).cast("long")
    score = (
        F.col("PaidOffLoans") * PAID_OFF_POINTS
        + k * F.lit(TRANSACTION_POINTS)
        - F.col("OverdueLoans") * OVERDUE_POINTS
    )
    return per_cust.join(who, "CustomerID").select(
        "CustomerID", "CustomerName", "CustomerType",
        F.col("TotalLoans").cast("long").alias("TotalLoans"),
        F.col("PaidOffLoans").cast("long").alias("PaidOffLoans"),
        F.col("OverdueLoans").cast("long").alias("OverdueLoans"),
        k.alias("TotalTransactions"),
        money(score).alias("CreditHealthScore"),
    )
