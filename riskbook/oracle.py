"""Independent SQL oracle (DuckDB dialect) for every registered query.

The oracle reads the generated tables (``customer orders lineitem events
part``), applies the same role mapping in SQL, and states each report in
its plain direct-join form: loans joined to transactions row by row, the
fan-out materialized, DISTINCT aggregates as written.  The Spark operators
use pre-aggregated plans instead, so agreement also checks that those
plans are equivalent.

Output types are fixed on both sides: counts BIGINT, cents DECIMAL(38,2),
ratios DECIMAL(38,4).  DuckDB divides and averages decimals in DOUBLE, so
such values pass through a wide DECIMAL before rounding.
"""

from __future__ import annotations

from .registry import AS_OF, ONE_CUSTOMER, SINCE, WHAT_IF_SHIFTS
from .sources.lookups import values_sql

# -- role mapping in SQL ---------------------------------------------------------

_ROLES = {
    "customers": """
    SELECT CAST(c_custkey AS BIGINT) AS CustomerID,
           CASE WHEN c_custkey % 97 = 0 THEN NULL
                WHEN c_custkey % 89 = 0 THEN ''
                WHEN c_custkey % 83 = 0 THEN '   '
                ELSE split_part(c_name, '#', 1) END AS FirstName,
           CASE WHEN c_custkey % 79 = 0 THEN '' ELSE split_part(c_name, '#', 2) END AS LastName,
           CASE WHEN c_custkey % 61 = 0 THEN NULL ELSE DATE '1950-01-01' END AS DateOfBirth,
           CAST(c_nationkey AS BIGINT) AS AddressID,
           CAST(CASE WHEN c_custkey % 71 = 0 THEN 99
                     WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 1
                     WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 2
                     ELSE 3 END AS INTEGER) AS CustomerTypeID
    FROM customer""",
    "accounts": """
    SELECT CAST(o_orderkey AS BIGINT) AS AccountID,
           CAST(CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_custkey END AS BIGINT) AS CustomerID,
           CAST(CASE WHEN o_orderkey % 401 = 0 THEN 9
                     ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS INTEGER) AS AccountTypeID,
           CAST(CASE WHEN o_orderkey % 307 = 0 THEN 9
                     WHEN o_orderstatus = 'F' THEN 1
                     WHEN o_orderstatus = 'O' THEN 2
                     ELSE 3 END AS INTEGER) AS AccountStatusID,
           CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
                ELSE CAST(0 AS DECIMAL(18,2)) END AS Balance
    FROM orders""",
    "loans": """
    SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS LoanID,
           CAST(CASE WHEN l_partkey % 503 = 0 THEN -1 ELSE l_orderkey END AS BIGINT) AS AccountID,
           CAST(CASE WHEN l_suppkey % 97 = 0 THEN 9
                     WHEN l_returnflag = 'N' THEN 1
                     WHEN l_returnflag = 'A' THEN 2
                     ELSE 3 END AS INTEGER) AS LoanStatusID,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS PrincipalAmount,
           CAST(l_discount AS DECIMAL(5,4)) AS InterestRate,
           CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE l_shipdate END AS StartDate,
           CASE WHEN l_partkey % 67 = 0 THEN l_shipdate - INTERVAL 30 DAY
                ELSE l_shipdate + INTERVAL 730 DAY END AS EstimatedEndDate
    FROM lineitem""",
    "transactions": """
    SELECT CAST(CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS BIGINT) AS TransactionID,
           CAST(CASE WHEN event_id % 211 = 0 THEN -1 ELSE user_id * 10 + event_id % 10 END AS BIGINT)
               AS AccountOriginID,
           CAST(user_id * 10 + (event_id + 3) % 10 AS BIGINT) AS AccountDestinationID,
           CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                                WHEN 'purchase' THEN 4 ELSE 9 END AS INTEGER) AS TransactionTypeID,
           CAST(value AS DECIMAL(18,2)) AS Amount,
           ts AS TransactionDate,
           CAST(CASE WHEN event_id % 53 >= 50 THEN -1 ELSE event_id % 53 + 1 END AS BIGINT) AS BranchID,
           props AS Description,
           event_id AS SourceRow
    FROM events""",
    "branches": """
    SELECT CAST(p_partkey + 1 AS BIGINT) AS BranchID,
           'Branch ' || CAST(p_partkey + 1 AS VARCHAR) AS BranchName,
           CAST(p_size AS BIGINT) AS AddressID
    FROM part""",
}

# -- derived tables over the role tables (also used on hand-made fixtures) ------

_DERIVED = {
    "transactions_clean": """
    SELECT TransactionID, AccountOriginID, AccountDestinationID, TransactionTypeID,
           Amount, TransactionDate, BranchID, Description
    FROM (SELECT *, row_number() OVER (PARTITION BY TransactionID
                                       ORDER BY TransactionDate NULLS FIRST, SourceRow) AS rn
          FROM transactions) ranked
    WHERE rn = 1""",
    "customers_final": """
    SELECT CustomerID,
           coalesce(nullif(trim(FirstName), ''), 'Unknown') AS FirstName,
           coalesce(nullif(trim(LastName), ''), 'Unknown') AS LastName,
           DateOfBirth, AddressID, CustomerTypeID
    FROM customers""",
    "customer_types": values_sql("customer_types"),
    "account_types": values_sql("account_types"),
    "account_statuses": values_sql("account_statuses"),
    "loan_statuses": values_sql("loan_statuses"),
    # the loan book: customer, type, account, loan, status
    "book": """
    SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, ct.TypeName AS CustomerType,
           a.AccountID, a.Balance, a.AccountTypeID, a.AccountStatusID,
           l.LoanID, l.PrincipalAmount, l.InterestRate, l.StartDate, l.EstimatedEndDate,
           ls.StatusName AS LoanStatus
    FROM customers_final c
    JOIN customer_types ct ON ct.CustomerTypeID = c.CustomerTypeID
    JOIN accounts a ON a.CustomerID = c.CustomerID
    JOIN loans l ON l.AccountID = a.AccountID
    JOIN loan_statuses ls ON ls.LoanStatusID = l.LoanStatusID""",
    # customer, type, account, loan (no status table)
    "book_any_status": """
    SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, ct.TypeName AS CustomerType,
           a.AccountID, a.Balance, l.LoanID, l.PrincipalAmount, l.InterestRate
    FROM customers_final c
    JOIN customer_types ct ON ct.CustomerTypeID = c.CustomerTypeID
    JOIN accounts a ON a.CustomerID = c.CustomerID
    JOIN loans l ON l.AccountID = a.AccountID""",
    "loans_ls": """
    SELECT l.*, ls.StatusName AS LoanStatus
    FROM loans l JOIN loan_statuses ls ON ls.LoanStatusID = l.LoanStatusID""",
}

ROLE_TABLES = ("customers", "accounts", "loans", "transactions", "branches")


def _with(ctes: dict[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body}\n)" for name, body in ctes.items())


_PREFIX = _with({**_ROLES, **_DERIVED})
_DERIVED_PREFIX = _with(_DERIVED)


def _sql(body: str) -> str:
    return f"{_PREFIX}\n{body.strip()}"


def over_roles(sql: str) -> str:
    """The same oracle query over role tables registered under their role
    names (customers, accounts, loans, transactions with SourceRow,
    branches) instead of the generated tables."""
    assert sql.startswith(_PREFIX)
    return _DERIVED_PREFIX + sql[len(_PREFIX):]


# -- output shaping ----------------------------------------------------------------

def _m(x: str) -> str:
    """Exact decimal rounded to cents."""
    return f"CAST(round({x}, 2) AS DECIMAL(38,2))"


def _md(x: str) -> str:
    """A DOUBLE (average, quotient) rounded to cents through DECIMAL(38,6)."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), 2) AS DECIMAL(38,2))"


def _pct(part: str, whole: str) -> str:
    return f"CAST(round(CAST({part} * 100.0 / nullif({whole}, 0) AS DECIMAL(38,10)), 2) AS DECIMAL(38,2))"


def _r4(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 4) AS DECIMAL(38,4))"


def _flags(col_map: dict[str, str]) -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN {cond} THEN 1 WHEN ({cond}) IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS {name}"
        for name, cond in col_map.items()
    )


_YIELD = "sum(PrincipalAmount * InterestRate)"


def _yield_at(shift: str) -> str:
    return f"sum(PrincipalAmount * (InterestRate + {shift}))"


_CUST_KEYS = "CustomerID, CustomerName, CustomerType"

# Per customer over the book: debt and distinct balances.
_SOLVENCY = """
SELECT {keys}, sum(PrincipalAmount) AS debt, sum(DISTINCT Balance) AS assets
FROM {table} {where}
GROUP BY {keys}"""


def _red_flags() -> str:
    s = _SOLVENCY.format(keys=_CUST_KEYS, table="book", where="WHERE LoanStatus = 'Overdue'")
    return f"""
SELECT * FROM (
  SELECT {_CUST_KEYS}, {_m('debt')} AS TotalLoanDebt, {_m('assets')} AS TotalLiquidAssets,
         {_r4('debt / nullif(assets, 0)')} AS DAR, {_m('debt - assets')} AS UncollateralizedDebt
  FROM ({s}) s
) r WHERE DAR > 1"""


def _segments() -> str:
    return """
SELECT CustomerType, count(LoanID) AS TotalLoans,
       CAST(sum(CASE WHEN LoanStatus = 'Overdue' THEN 1 ELSE 0 END) AS BIGINT) AS OverdueLoans
FROM book GROUP BY CustomerType"""


def _health(count_name: str) -> str:
    return f"""
SELECT LoanStatus, count(LoanID) AS {count_name}, {_m('sum(PrincipalAmount)')} AS TotalPrincipal,
       {_m(_YIELD)} AS ExpectedYield,
       {_pct('count(LoanID)', 'sum(count(LoanID)) OVER ()')} AS PctOfPortfolio
FROM loans_ls GROUP BY LoanStatus"""


def _top_customers(select: str, order: str, n: int | None = 20) -> str:
    lim = f" LIMIT {n}" if n else ""
    return f"{select}\nORDER BY {order} DESC NULLS LAST, CustomerID NULLS FIRST{lim}"


def _orphans(child: str, fk: str, parent: str, pk: str, cols: str) -> str:
    return (f"SELECT {cols} FROM {child} x "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = x.{fk})")


def _orphan_count(label: str, child: str, fk: str, parent: str, pk: str) -> str:
    return (f"SELECT '{label}' AS relationship, count(*) AS orphan_count FROM {child} x "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = x.{fk})")


def _what_if(shift) -> str:
    s = f"CAST({shift} AS DECIMAL(5,4))"
    return f"""
SELECT LoanStatus, count(LoanID) AS TotalLoans, {_m('sum(PrincipalAmount)')} AS TotalPrincipal,
       {_m(_YIELD)} AS CurrentYield, {_m(_yield_at(s))} AS SimulatedYield,
       {_m(f'{_yield_at(s)} - {_YIELD}')} AS YieldDelta
FROM loans_ls GROUP BY LoanStatus"""


def _monthly(table: str, date_col: str, amount: str, ident: str) -> str:
    return f"""
SELECT TxMonth, TxCount, TotalVolume,
       lag(TotalVolume) OVER w AS PrevMonthVolume,
       lead(TotalVolume) OVER w AS NextMonthVolume,
       {_m('TotalVolume - lag(TotalVolume) OVER w')} AS MoM_Change
FROM (SELECT strftime({date_col}, '%Y-%m') AS TxMonth, count({ident}) AS TxCount,
             {_m(f'sum({amount})')} AS TotalVolume
      FROM {table} GROUP BY 1) m
WINDOW w AS (ORDER BY TxMonth NULLS FIRST)"""


_BOOK_ROW = "CustomerID, CustomerName, CustomerType, AccountID"


def _score(where: str = "") -> str:
    return f"""
SELECT CustomerID, CustomerName, CustomerType,
       count(DISTINCT LoanID) AS TotalLoans,
       CAST(sum(CASE WHEN LoanStatus = 'Paid Off' THEN 1 ELSE 0 END) AS BIGINT) AS PaidOffLoans,
       CAST(sum(CASE WHEN LoanStatus = 'Overdue' THEN 1 ELSE 0 END) AS BIGINT) AS OverdueLoans,
       count(DISTINCT t.TransactionID) AS TotalTransactions,
       CAST(round(sum(CASE WHEN LoanStatus = 'Paid Off' THEN 1 ELSE 0 END) * 50
                  + count(DISTINCT t.TransactionID) * 0.1
                  - sum(CASE WHEN LoanStatus = 'Overdue' THEN 1 ELSE 0 END) * 30, 2) AS DECIMAL(38,2))
           AS CreditHealthScore
FROM book b LEFT JOIN transactions_clean t ON t.AccountOriginID = b.AccountID
{where}
GROUP BY CustomerID, CustomerName, CustomerType"""


ORACLE: dict[str, str] = {
    # stage 1
    "null_audit_customers": _sql(f"""
SELECT count(*) AS total_rows, {_flags({
        'null_first_name': 'FirstName IS NULL', 'null_last_name': 'LastName IS NULL',
        'null_dob': 'DateOfBirth IS NULL', 'null_address_id': 'AddressID IS NULL',
        'null_customer_type': 'CustomerTypeID IS NULL'})}
FROM customers"""),
    "null_audit_loans": _sql(f"""
SELECT count(*) AS total_rows, {_flags({
        'null_status': 'LoanStatusID IS NULL', 'null_principal': 'PrincipalAmount IS NULL',
        'null_rate': 'InterestRate IS NULL', 'null_start_date': 'StartDate IS NULL',
        'null_end_date': 'EstimatedEndDate IS NULL'})}
FROM loans"""),
    "duplicate_transactions": _sql("""
SELECT TransactionID, count(*) AS cnt FROM transactions GROUP BY TransactionID HAVING count(*) > 1"""),
    "blank_audit_customers": _sql(f"""
SELECT {_flags({'empty_first_name': "FirstName = ''", 'empty_last_name': "LastName = ''",
                'total_bad_name_rows': "FirstName = '' OR LastName = ''"})}
FROM customers"""),
    "duplicate_transaction_count": _sql("""
SELECT count(*) AS total_duplicate_rows
FROM (SELECT TransactionID FROM transactions GROUP BY TransactionID HAVING count(*) > 1) d"""),
    "dedupe_transactions": _sql("SELECT * FROM transactions_clean"),
    "verify_dedupe": _sql("""
SELECT count(*) AS remaining_duplicates FROM transactions_clean
GROUP BY TransactionID HAVING count(*) > 1"""),
    # The labels of the published analysis, in this and the next query.
    "loan_risk_bucket": _sql("""
SELECT LoanID, PrincipalAmount, InterestRate,
       CASE WHEN InterestRate < 0.05 THEN 'Low Risk'
            WHEN InterestRate < 0.10 THEN 'Medium Risk'
            ELSE 'High Risk' END AS RiskCategory
FROM loans"""),
    "loan_date_anomalies": _sql(f"""
SELECT LoanID, StartDate, EstimatedEndDate,
       CASE WHEN StartDate > TIMESTAMP '{AS_OF}' THEN 'Future Start — Anomaly'
            WHEN EstimatedEndDate < StartDate THEN 'End Before Start — Anomaly'
            ELSE 'Valid' END AS DateCheck
FROM loans
WHERE StartDate > TIMESTAMP '{AS_OF}' OR EstimatedEndDate < StartDate"""),
    "clean_customers": _sql("SELECT * FROM customers_final"),
    "placeholder_name_count": _sql("""
SELECT count(*) AS bad_name_rows FROM customers_final
WHERE FirstName = 'Unknown' OR LastName = 'Unknown'"""),
    # stage 2
    "orphan_accounts": _sql(_orphans("accounts", "CustomerID", "customers", "CustomerID",
                                     "AccountID, CustomerID")),
    "orphan_loans": _sql(_orphans("loans", "AccountID", "accounts", "AccountID", "LoanID, AccountID")),
    "orphan_transactions_account": _sql(_orphans("transactions_clean", "AccountOriginID", "accounts",
                                                 "AccountID", "TransactionID, AccountOriginID")),
    "orphan_transactions_branch": _sql(_orphans("transactions_clean", "BranchID", "branches", "BranchID",
                                                "TransactionID, BranchID")),
    "invalid_loan_status": _sql(_orphans("loans", "LoanStatusID", "loan_statuses", "LoanStatusID",
                                         "LoanID, LoanStatusID")),
    "invalid_account_codes": _sql("""
SELECT a.AccountID, a.AccountTypeID, a.AccountStatusID,
       CASE WHEN t.AccountTypeID IS NULL THEN 'Invalid Type' ELSE 'Valid' END AS TypeCheck,
       CASE WHEN s.AccountStatusID IS NULL THEN 'Invalid Status' ELSE 'Valid' END AS StatusCheck
FROM accounts a
LEFT JOIN account_types t ON t.AccountTypeID = a.AccountTypeID
LEFT JOIN account_statuses s ON s.AccountStatusID = a.AccountStatusID
WHERE t.AccountTypeID IS NULL OR s.AccountStatusID IS NULL"""),
    "invalid_customer_type": _sql(_orphans("customers_final", "CustomerTypeID", "customer_types",
                                           "CustomerTypeID", "CustomerID, CustomerTypeID")),
    "integrity_summary": _sql("\nUNION ALL\n".join([
        _orphan_count("accounts → customers", "accounts", "CustomerID", "customers", "CustomerID"),
        _orphan_count("loans → accounts", "loans", "AccountID", "accounts", "AccountID"),
        _orphan_count("transactions → accounts", "transactions_clean", "AccountOriginID", "accounts",
                      "AccountID"),
        _orphan_count("transactions → branches", "transactions_clean", "BranchID", "branches", "BranchID"),
        _orphan_count("loans → loan_statuses", "loans", "LoanStatusID", "loan_statuses", "LoanStatusID"),
        _orphan_count("customers → customer_types", "customers_final", "CustomerTypeID", "customer_types",
                      "CustomerTypeID"),
    ])),
    # stage 3
    "customer_accounts": _sql("""
SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, ct.TypeName AS CustomerType,
       a.AccountID, t.TypeName AS AccountType, s.StatusName AS AccountStatus, a.Balance
FROM customers_final c
JOIN customer_types ct ON ct.CustomerTypeID = c.CustomerTypeID
JOIN accounts a ON a.CustomerID = c.CustomerID
JOIN account_types t ON t.AccountTypeID = a.AccountTypeID
JOIN account_statuses s ON s.AccountStatusID = a.AccountStatusID"""),
    "customer_loans": _sql(f"""
SELECT {_BOOK_ROW}, Balance AS AccountBalance, LoanID, PrincipalAmount, InterestRate, LoanStatus FROM book"""),
    "master_portfolio": _sql(f"""
SELECT b.CustomerID, b.CustomerName, b.CustomerType, b.AccountID, t.TypeName AS AccountType,
       s.StatusName AS AccountStatus, b.Balance AS AccountBalance, b.LoanID, b.PrincipalAmount,
       {_m('b.InterestRate * 100')} AS InterestRate_Pct, b.LoanStatus, b.StartDate, b.EstimatedEndDate
FROM book b
JOIN account_types t ON t.AccountTypeID = b.AccountTypeID
JOIN account_statuses s ON s.AccountStatusID = b.AccountStatusID"""),
    "loan_transaction_summary": _sql(f"""
SELECT b.CustomerID, b.CustomerName, b.CustomerType, b.AccountID, b.Balance AS AccountBalance,
       b.LoanID, b.PrincipalAmount, b.LoanStatus,
       count(t.TransactionID) AS TotalTransactions, {_m('sum(t.Amount)')} AS TotalTransactionVolume
FROM book b LEFT JOIN transactions_clean t ON t.AccountOriginID = b.AccountID
GROUP BY b.CustomerID, b.CustomerName, b.CustomerType, b.AccountID, b.Balance,
         b.LoanID, b.PrincipalAmount, b.LoanStatus"""),
    "accounts_without_loans": _sql("""
SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, ct.TypeName AS CustomerType,
       a.AccountID, a.Balance
FROM customers_final c
JOIN customer_types ct ON ct.CustomerTypeID = c.CustomerTypeID
JOIN accounts a ON a.CustomerID = c.CustomerID
LEFT JOIN loans l ON l.AccountID = a.AccountID
WHERE l.LoanID IS NULL"""),
    # stage 4
    "exposure_by_status": _sql(f"""
SELECT LoanStatus, count(LoanID) AS TotalLoans, {_m('sum(PrincipalAmount)')} AS TotalPrincipal,
       {_md('avg(PrincipalAmount)')} AS AvgLoanSize
FROM loans_ls GROUP BY LoanStatus ORDER BY TotalPrincipal DESC"""),
    "yield_by_status": _sql(f"""
SELECT LoanStatus, {_m('sum(PrincipalAmount)')} AS TotalPrincipal, {_m(_YIELD)} AS ExpectedYield,
       {_md('avg(InterestRate * 100)')} AS AvgInterestRate_Pct
FROM loans_ls GROUP BY LoanStatus ORDER BY ExpectedYield DESC"""),
    "portfolio_scorecard": _sql(_health("LoanCount") + "\nORDER BY TotalPrincipal DESC"),
    "exposure_by_segment": _sql(f"""
SELECT CustomerType, count(LoanID) AS TotalLoans, {_m('sum(PrincipalAmount)')} AS TotalExposure,
       {_m(_YIELD)} AS ExpectedYield, {_md('avg(InterestRate * 100)')} AS AvgInterestRate_Pct
FROM book_any_status GROUP BY CustomerType ORDER BY TotalExposure DESC"""),
    "overdue_exposure": _sql(f"""
SELECT {_m('sum(PrincipalAmount)')} AS OverduePrincipal, {_m(_YIELD)} AS OverdueExpectedYield,
       count(LoanID) AS OverdueLoanCount, {_md('avg(InterestRate * 100)')} AS AvgOverdueRate_Pct
FROM loans_ls WHERE LoanStatus = 'Overdue'"""),
    # stage 5
    "debt_per_customer": _sql(_top_customers(f"""
SELECT {_CUST_KEYS}, {_m('sum(PrincipalAmount)')} AS TotalLoanDebt
FROM book_any_status GROUP BY {_CUST_KEYS}""", "TotalLoanDebt")),
    "assets_per_customer": _sql(_top_customers("""
SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName,
       CAST(round(sum(a.Balance), 2) AS DECIMAL(38,2)) AS TotalLiquidAssets
FROM customers_final c JOIN accounts a ON a.CustomerID = c.CustomerID
GROUP BY c.CustomerID, c.FirstName || ' ' || c.LastName""", "TotalLiquidAssets")),
    "liquidity_gap": _sql(_top_customers(f"""
SELECT {_CUST_KEYS}, {_m('debt')} AS TotalLoanDebt, {_m('assets')} AS TotalLiquidAssets,
       {_m('debt - assets')} AS LiquidityGap
FROM ({_SOLVENCY.format(keys=_CUST_KEYS, table='book_any_status', where='')}) s""", "LiquidityGap")),
    "debt_to_asset_ratio": _sql(_top_customers(f"""
SELECT {_CUST_KEYS}, {_m('debt')} AS TotalLoanDebt, {_m('assets')} AS TotalLiquidAssets,
       {_r4('debt / nullif(assets, 0)')} AS DAR
FROM ({_SOLVENCY.format(keys=_CUST_KEYS, table='book_any_status', where='')}) s""", "DAR")),
    "red_flag_list": _sql(_red_flags() + "\nORDER BY UncollateralizedDebt DESC"),
    # stage 6
    "segment_default_rate": _sql(f"""
SELECT CustomerType, TotalLoans, OverdueLoans, {_pct('OverdueLoans', 'TotalLoans')} AS DefaultRate_Pct
FROM ({_segments()}) s ORDER BY DefaultRate_Pct DESC"""),
    "segment_rank": _sql(f"""
SELECT *, rank() OVER (ORDER BY DefaultRate_Pct DESC NULLS LAST) AS RankByDefault,
          dense_rank() OVER (ORDER BY DefaultRate_Pct DESC NULLS LAST) AS DenseRankByDefault
FROM (SELECT CustomerType, TotalLoans, OverdueLoans,
             {_pct('OverdueLoans', 'TotalLoans')} AS DefaultRate_Pct
      FROM ({_segments()}) s) r"""),
    "branch_default_rank": _sql(f"""
SELECT BranchID, BranchName, TotalLoans, OverdueLoans, DefaultRate_Pct,
       rank() OVER (ORDER BY DefaultRate_Pct DESC NULLS LAST) AS RiskRank
FROM (SELECT b.BranchID, b.BranchName, count(l.LoanID) AS TotalLoans,
             CAST(sum(CASE WHEN l.LoanStatus = 'Overdue' THEN 1 ELSE 0 END) AS BIGINT) AS OverdueLoans,
             {_pct("sum(CASE WHEN l.LoanStatus = 'Overdue' THEN 1 ELSE 0 END)", 'count(l.LoanID)')}
                 AS DefaultRate_Pct
      FROM branches b
      JOIN transactions_clean t ON t.BranchID = b.BranchID
      JOIN accounts a ON a.AccountID = t.AccountOriginID
      JOIN loans_ls l ON l.AccountID = a.AccountID
      GROUP BY b.BranchID, b.BranchName) br
ORDER BY RiskRank, BranchID LIMIT 20"""),
    "monthly_volume_trend": _sql(_monthly("transactions_clean", "TransactionDate", "Amount", "TransactionID")
                                 + "\nORDER BY TxMonth NULLS FIRST"),
    "monthly_volume_trend_orders": _sql(_monthly(
        "(SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders) o",
        "o_orderdate", "o_totalprice", "o_orderkey") + "\nORDER BY TxMonth NULLS FIRST"),
    "running_exposure": _sql(f"""
SELECT LoanMonth, {_m('p')} AS MonthlyExposure,
       {_m('sum(p) OVER (ORDER BY LoanMonth NULLS FIRST)')} AS RunningTotalExposure
FROM (SELECT strftime(StartDate, '%Y-%m') AS LoanMonth, sum(PrincipalAmount) AS p
      FROM loans GROUP BY 1) m
ORDER BY LoanMonth NULLS FIRST"""),
    # stage 7
    "loans_by_status": _sql("SELECT LoanID, PrincipalAmount, LoanStatusID FROM loans WHERE LoanStatusID = 2"),
    "top_accounts_by_volume": _sql(f"""
SELECT AccountOriginID, count(TransactionID) AS TxCount, {_m('sum(Amount)')} AS TotalVolume
FROM transactions_clean WHERE TransactionDate >= TIMESTAMP '{SINCE}'
GROUP BY AccountOriginID
ORDER BY TotalVolume DESC NULLS LAST, AccountOriginID NULLS FIRST LIMIT 20"""),
    "portfolio_slim": _sql(f"""
SELECT {_BOOK_ROW}, Balance AS AccountBalance, LoanID, PrincipalAmount, LoanStatus FROM book"""),
    "write_clustered": _sql("SELECT LoanID, PrincipalAmount, LoanStatusID FROM loans WHERE LoanStatusID = 2"),
    "clustered_transactions": _sql(f"""
SELECT strftime(TransactionDate, '%Y-%m') AS TxMonth, AccountOriginID, count(*) AS TxRows,
       {_m('sum(Amount)')} AS TotalVolume
FROM transactions_clean GROUP BY ALL"""),
    "clustered_customers": _sql("""
SELECT CustomerTypeID, count(*) AS Customers, min(CustomerID) AS FirstCustomerID, max(CustomerID) AS LastCustomerID
FROM customers_final GROUP BY CustomerTypeID"""),
    "clustered_accounts": _sql(f"""
SELECT CustomerID, count(*) AS Accounts, {_m('sum(Balance)')} AS TotalBalance
FROM accounts GROUP BY CustomerID"""),
    # stage 8a
    "vw_portfolio_health": _sql(_health("TotalLoans")),
    "vw_portfolio_health_overdue": _sql(f"SELECT * FROM ({_health('TotalLoans')}) v WHERE LoanStatus = 'Overdue'"),
    "vw_portfolio_health_sorted": _sql(f"SELECT * FROM ({_health('TotalLoans')}) v ORDER BY TotalPrincipal DESC"),
    "vw_red_flag_customers": _sql(_red_flags()),
    "vw_red_flag_enterprise": _sql(f"SELECT * FROM ({_red_flags()}) v WHERE CustomerType = 'Large Enterprise'"),
    "vw_red_flag_top5": _sql(f"""
SELECT * FROM ({_red_flags()}) v
ORDER BY UncollateralizedDebt DESC NULLS LAST, CustomerID NULLS FIRST LIMIT 5"""),
    "vw_segment_rankings": _sql(f"""
SELECT CustomerType, TotalLoans, OverdueLoans, {_pct('OverdueLoans', 'TotalLoans')} AS DefaultRate_Pct,
       rank() OVER (ORDER BY OverdueLoans * 100.0 / nullif(TotalLoans, 0) DESC NULLS LAST) AS RiskRank
FROM ({_segments()}) s"""),
    "credit_health_score": _sql(_score()),
    "credit_health_score_one": _sql(_score(f"WHERE CustomerID = {ONE_CUSTOMER}")),
    "customers_with_loans": _sql("""
SELECT DISTINCT c.CustomerID, c.FirstName, c.LastName
FROM customers_final c
JOIN accounts a ON a.CustomerID = c.CustomerID
JOIN loans l ON l.AccountID = a.AccountID"""),
    # stage 8b
    "baseline_yield": _sql(f"""
SELECT LoanStatus, count(LoanID) AS TotalLoans, {_m('sum(PrincipalAmount)')} AS TotalPrincipal,
       {_m(_YIELD)} AS CurrentYield
FROM loans_ls GROUP BY LoanStatus ORDER BY TotalPrincipal DESC"""),
    "rate_scenarios": _sql(f"""
SELECT LoanStatus, {_m(_YIELD)} AS CurrentYield,
       {_m(_yield_at('-0.01'))} AS Yield_Minus1Pct, {_m(_yield_at('-0.02'))} AS Yield_Minus2Pct,
       {_m(_yield_at('0.01'))} AS Yield_Plus1Pct, {_m(_yield_at('0.02'))} AS Yield_Plus2Pct
FROM loans_ls GROUP BY LoanStatus ORDER BY LoanStatus"""),
    "rate_deltas": _sql(f"""
SELECT LoanStatus, {_m(_YIELD)} AS CurrentYield,
       {_m(_yield_at('0.01') + ' - ' + _YIELD)} AS Delta_Plus1Pct,
       {_m(_yield_at('0.02') + ' - ' + _YIELD)} AS Delta_Plus2Pct,
       {_m(_yield_at('-0.01') + ' - ' + _YIELD)} AS Delta_Minus1Pct,
       {_m(_yield_at('-0.02') + ' - ' + _YIELD)} AS Delta_Minus2Pct
FROM loans_ls GROUP BY LoanStatus ORDER BY LoanStatus"""),
    "overdue_ecl": _sql(f"""
SELECT {_m('sum(PrincipalAmount)')} AS OverduePrincipal, {_m(_YIELD)} AS ECL_CurrentRate,
       {_m(_yield_at('0.01'))} AS ECL_Plus1Pct, {_m(_yield_at('0.02'))} AS ECL_Plus2Pct,
       {_m(_yield_at('-0.01'))} AS ECL_Minus1Pct, {_m(_yield_at('-0.02'))} AS ECL_Minus2Pct
FROM loans_ls WHERE LoanStatus = 'Overdue'"""),
}
for _name, _shift in WHAT_IF_SHIFTS.items():
    ORACLE[_name] = _sql(_what_if(_shift))
