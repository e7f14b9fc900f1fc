"""The three report views as lasting SQL views over catalog tables.

A view is re-evaluated at each read, so its text must be SQL over tables that
another session finds by name.  ``create_views`` expects the Book's tables and
snapshots in one database (``run.register_views`` writes them there).
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _round(x: str, places: int = 2) -> str:
    return f"CAST(round({x}, {places}) AS decimal(38,{places}))"


def view_sql(db: str) -> dict[str, str]:
    """The text of each view over the tables of ``db``."""
    per_account = f"""
        SELECT a.CustomerID, a.Balance, s.StatusName AS LoanStatus, l.ids, l.`rows` AS loans, l.p AS principal
        FROM {db}.loan_rollup l
        JOIN {db}.loan_statuses s ON s.LoanStatusID = l.LoanStatusID
        JOIN {db}.accounts a ON a.AccountID = l.AccountID"""
    segments = f"""
        SELECT t.TypeName AS CustomerType, sum(x.ids) AS TotalLoans,
               sum(CASE WHEN x.LoanStatus = 'Overdue' THEN x.loans ELSE 0 END) AS OverdueLoans
        FROM ({per_account}) x
        JOIN {db}.customers_final c ON c.CustomerID = x.CustomerID
        JOIN {db}.customer_types t ON t.CustomerTypeID = c.CustomerTypeID
        GROUP BY t.TypeName"""
    rate = "OverdueLoans * 100.0 / nullif(TotalLoans, 0)"
    return {
        "vw_PortfolioHealth": f"""
        SELECT LoanStatus, TotalLoans, TotalPrincipal, ExpectedYield,
               {_round('TotalLoans * 100.0 / nullif(sum(TotalLoans) OVER (), 0)')} AS PctOfPortfolio
        FROM (SELECT s.StatusName AS LoanStatus, sum(l.ids) AS TotalLoans,
                     {_round('sum(l.p)')} AS TotalPrincipal, {_round('sum(l.pr)')} AS ExpectedYield
              FROM {db}.loan_rollup l JOIN {db}.loan_statuses s ON s.LoanStatusID = l.LoanStatusID
              GROUP BY s.StatusName)""",
        "vw_RedFlagCustomers": f"""
        SELECT CustomerID, CustomerName, CustomerType, {_round('debt')} AS TotalLoanDebt,
               {_round('assets')} AS TotalLiquidAssets, DAR, {_round('debt - assets')} AS UncollateralizedDebt
        FROM (SELECT *, {_round('CAST(debt AS decimal(24,2)) / nullif(CAST(assets AS decimal(24,2)), 0)', 4)} AS DAR
              FROM (SELECT c.CustomerID, concat(c.FirstName, ' ', c.LastName) AS CustomerName,
                           t.TypeName AS CustomerType, sum(x.principal) AS debt, sum(DISTINCT x.Balance) AS assets
                    FROM ({per_account}) x
                    JOIN {db}.customers_final c ON c.CustomerID = x.CustomerID
                    JOIN {db}.customer_types t ON t.CustomerTypeID = c.CustomerTypeID
                    WHERE x.LoanStatus = 'Overdue'
                    GROUP BY c.CustomerID, c.FirstName, c.LastName, t.TypeName))
        WHERE DAR > 1""",
        "vw_SegmentRankings": f"""
        SELECT CustomerType, TotalLoans, OverdueLoans, {_round(rate)} AS DefaultRate_Pct,
               CAST(rank() OVER (ORDER BY {rate} DESC NULLS LAST) AS bigint) AS RiskRank
        FROM ({segments})""",
    }


def create_views(spark: SparkSession, db: str) -> list[str]:
    for name, text in view_sql(db).items():
        spark.sql(f"CREATE OR REPLACE VIEW {db}.{name} AS {text}")
    return [f"{db}.{name}" for name in view_sql(db)]
