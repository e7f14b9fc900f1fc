"""The loan book: one bundle of role tables that every operator reads.

Facts (loans, transactions) may hold repeated rows; parents (customers,
accounts, branches and the code tables) are keyed by their id
(``repeated_parent_keys`` lists violations).  Derived snapshot tables (the
de-duplicated transactions, the cleaned customers, the account-customer
dimension, the transactions per account, the loan rollup) are built once per
Book.

``prepared()`` gives the Book a store: a table with a layout or a snapshot is
written there the first time a report asks for it, so only what the chosen
reports read is written, and input tables that need no layout are read in
place.  ``close()`` drops the store.  A Book built directly (tests, small
inputs) keeps every table as a plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_key
from ..plans.joins import bounded_broadcast
from ..plans.materialize import Store, merge_first
from ..plans.skew import HotKeys, find_hot_keys
from . import lookups, readers, roles, schemas

REQUIRED = ("customers", "accounts", "loans", "transactions", "branches")
# Layouts (re-aimed from the published index definitions, and that of the month
# rollup): directories, and the composite range that files and rows are sorted by.
LAYOUTS = {
    "loans": (["LoanStatusID"], ["AccountID", "LoanID"]),
    "transactions_clean": (["TxMonth"], ["AccountOriginID", "TransactionID"]),
    "tx_months": (["TxMonth"], ["AccountOriginID"]),
    "customers_final": (["CustomerTypeID"], ["CustomerID"]),
    "accounts": ([], ["CustomerID", "AccountID"]),
}
# A one-customer call looks up at most so many accounts and files by name.
MOST_IDS, MOST_FILES = 1000, 10_000
CODE_TABLES = ("customer_types", "account_types", "account_statuses", "loan_statuses", "transaction_types")


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.BY_NAME[name])


@dataclass
class Book:
    spark: SparkSession
    customers: DataFrame
    accounts: DataFrame
    raw_loans: DataFrame
    transactions: DataFrame
    branches: DataFrame
    codes: dict[str, DataFrame]
    # Code tables made from a literal list have a known size: broadcast them.
    fixed_codes: bool = True
    # Tie-break columns after TransactionDate for keep-first de-duplication.
    tx_tiebreak: tuple[str, ...] = ("SourceRow",)
    # Where a prepared Book writes its tables (None: they stay plans).
    store: Store | None = field(default=None, repr=False)
    # The files that the tables are read from, if they are files.
    inputs: tuple[str, ...] = ()
    # Hot keys, by "table.column" (see plans.skew).
    hot: dict = field(default_factory=dict)
    hot_key_rows: int | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    # -- constructors -------------------------------------------------------
    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Book":
        t = roles.read_driver_tables(spark, sf_dir)
        codes = {n: lookups.lookup(spark, n) for n in CODE_TABLES}
        return cls(spark, t["customers"], t["accounts"], t["loans"], t["transactions"],
                   t["branches"], codes, inputs=tuple(roles.input_paths(sf_dir)))

    @classmethod
    def from_csv(cls, spark: SparkSession, data_dir: str, customers: DataFrame | None = None,
                 accounts: DataFrame | None = None) -> "Book":
        """The published CSV tables (all must be there); customers and
        accounts are not shipped with them, so they are passed in (empty
        tables otherwise)."""
        t = readers.read_csv_dir(spark, data_dir)
        return cls(
            spark,
            customers if customers is not None else _empty(spark, "customers"),
            accounts if accounts is not None else _empty(spark, "accounts"),
            t["loans"], t["transactions"], t["branches"], {n: t[n] for n in CODE_TABLES},
            fixed_codes=False, tx_tiebreak=(), inputs=(data_dir,),
        )

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: dict[str, str]) -> "Book":
        """Role tables from files (``.csv`` with a header, else parquet), by
        role name: customers, accounts, loans, transactions, branches (all
        required) and the code tables.  Every table is read with its fixed
        schema."""
        missing = [n for n in REQUIRED if n not in paths]
        if missing:
            raise ValueError(f"tables missing: {', '.join(missing)}")
        frames = {name: readers.read_table(spark, name, path) for name, path in paths.items()}
        return replace(cls.from_frames(spark, **frames), inputs=tuple(paths.values()))

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Book":
        """Tables given directly (tests); missing ones are empty, code tables
        default to the fixed lists."""
        codes = {n: frames.get(n, lookups.lookup(spark, n)) for n in CODE_TABLES}
        tx = frames.get("transactions", _empty(spark, "transactions"))
        tiebreak = ("SourceRow",) if "SourceRow" in tx.columns else ()
        return cls(
            spark,
            frames.get("customers", _empty(spark, "customers")),
            frames.get("accounts", _empty(spark, "accounts")),
            frames.get("loans", _empty(spark, "loans")),
            tx,
            frames.get("branches", _empty(spark, "branches")),
            codes,
            fixed_codes=not any(n in frames for n in CODE_TABLES),
            tx_tiebreak=tiebreak,
        )

    # -- load ---------------------------------------------------------------
    def prepared(self, database: str | None = None) -> "Book":
        """This Book with a store for its written tables (``database``: a
        lasting one, whose tables keep their names)."""
        return replace(self, store=Store(self.spark, database, self.inputs), hot={}, _cache={})

    def load(self) -> "Book":
        """Write every table now (each is otherwise written at first use)."""
        self.loans, self.transactions_by_month, self.customers_final  # noqa: B018
        self.account_customers, self.tx_months, self.tx_accounts, self.loan_rollup  # noqa: B018
        for name in ("accounts.CustomerID", "loans.AccountID", "transactions.AccountOriginID", "transactions.BranchID"):
            self.hot_keys(name)
        self.branch_dim()
        return self

    def close(self) -> None:
        """Drop the written tables."""
        if self.store is not None:
            self.store.drop()
            self._cache.clear()
            self.hot.clear()

    def hot_keys(self, name: str) -> HotKeys | None:
        """Hot keys of "accounts.CustomerID", "loans.AccountID" or
        "transactions.AccountOriginID" / ".BranchID": found once by a prepared
        Book, None otherwise (AQE splits skewed joins then)."""
        if name not in self.hot and self.store is not None:
            table, key = name.split(".")
            df = self.transactions_clean if table == "transactions" else getattr(self, table)
            self.hot[name] = find_hot_keys(df.select(key), key, self.hot_key_rows, self.store,
                                            name.replace(".", "_"))
        return self.hot.get(name)

    def find_hot_keys(self) -> "Book":
        """Find hot keys on this Book as it stands."""
        self.hot["accounts.CustomerID"] = find_hot_keys(self.accounts, "CustomerID", self.hot_key_rows)
        self.hot["loans.AccountID"] = find_hot_keys(self.loans, "AccountID", self.hot_key_rows)
        self.hot["transactions.AccountOriginID"] = find_hot_keys(self.transactions_clean, "AccountOriginID",
                                                                 self.hot_key_rows)
        return self

    def repeated_parent_keys(self) -> DataFrame:
        """Parent tables with a key that repeats (``parent``, ``keys``): the
        broadcast slices and the pre-aggregated reports expect none."""
        parents = [("customers", self.customers, "CustomerID"), ("accounts", self.accounts, "AccountID"),
                   ("branches", self.branches, "BranchID")]
        out = None
        for name, df, key in parents:
            part = (df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
                    .agg(F.count("*").alias("keys")).filter("keys > 0")
                    .select(F.lit(name).alias("parent"), "keys"))
            out = part if out is None else out.unionByName(part)
        return out

    # -- dimensions ---------------------------------------------------------
    def fixed_code_pairs(self, name: str) -> list[tuple[int, str]] | None:
        """The (id, name) list of a code table when it is the fixed list
        (so ids are unique and the size is known); None when read from data."""
        return list(lookups.FIXED[name]) if self.fixed_codes else None

    def _small(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, broadcast if a prepared Book found it small at load."""
        if self.store is None:
            return df
        key = ("small", name)
        if key not in self._cache:
            self._cache[key], _ = bounded_broadcast(df)
        return self._cache[key]

    def code(self, name: str) -> DataFrame:
        """A code table, broadcast when its size is known or checked."""
        return F.broadcast(self.codes[name]) if self.fixed_codes else self._small(name, self.codes[name])

    def branch_dim(self) -> DataFrame:
        return self._small("branches", self.branches)

    # -- derived snapshots --------------------------------------------------
    def _snapshot(self, name: str, build, write) -> DataFrame:
        """A derived table, built once; a prepared Book writes it."""
        if name not in self._cache:
            df = build()
            self._cache[name] = df if self.store is None else write(df)
        return self._cache[name]

    def _layout(self, name: str, df: DataFrame, table: str | None = None) -> DataFrame:
        return self.store.layout(df, table or name, *LAYOUTS[name])

    def clustered(self, name: str) -> DataFrame:
        """A table of ``LAYOUTS`` in its layout (as given without a store)."""
        if name == "loans":
            return self.loans
        if name == "transactions_clean":
            return self.transactions_by_month
        df = getattr(self, name)
        return self._snapshot(f"{name}_clustered", lambda: df, lambda d: self._layout(name, d, f"{name}_clustered"))

    @property
    def loans(self) -> DataFrame:
        """Loans; in a prepared Book a directory per status, and files that
        hold ranges of (account, loan)."""
        return self._snapshot("loans", lambda: self.raw_loans, lambda d: self._layout("loans", d))

    def accounts_of(self, customer_id: int, most: int = MOST_IDS) -> list[int] | None:
        """The accounts of one customer, from the accounts layout (files hold
        ranges of customers); None if there are more than ``most``, or if this
        Book has no layout to look them up in."""
        if self.store is None:
            return None
        found = (self.clustered("accounts").filter(F.col("CustomerID") == customer_id)
                 .filter(F.col("AccountID").isNotNull()).select("AccountID").distinct().limit(most + 1).collect())
        return None if len(found) > most else [r["AccountID"] for r in found]

    def loans_of(self, accounts: list[int], most: int = MOST_FILES) -> DataFrame:
        """Loans of a few accounts.  A prepared Book opens only the files whose
        range of accounts holds one of them (all files if those are more than
        ``most``; the filter on the account then skips by file statistics)."""
        own = self.loans.filter(F.col("AccountID").isin(accounts))
        if self.store is None:
            return own
        files = self._snapshot("loans_files", lambda: self.loans, lambda d: self.store.file_ranges("loans", "AccountID"))
        ids = F.array(*[F.lit(a) for a in accounts]) if accounts else F.expr("cast(array() as array<int>)")
        hit = files.filter(F.exists(ids, lambda a: (F.col("lo") <= a) & (a <= F.col("hi")))).select("file")
        names = [r["file"] for r in hit.limit(most + 1).collect()]
        return own if len(names) > most else own.filter(F.col("_metadata.file_path").isin(names))

    @property
    def transactions_by_month(self) -> DataFrame:
        """The de-duplicated transactions with their month (``TxMonth``) and
        the rows their id had (``Copies``); in a prepared Book a directory per
        month."""
        return self._snapshot("transactions_clean", lambda: self._dedupe(self.transactions),
                              lambda d: self._layout("transactions_clean", d))

    def _dedupe(self, transactions: DataFrame) -> DataFrame:
        from ..operators.quality import dedupe_counted, transaction_order

        first = dedupe_counted(transactions, "TransactionID", transaction_order(self), schemas.TRANSACTION_COLUMNS)
        return first.withColumn("TxMonth", month_key("TransactionDate"))

    @property
    def transactions_clean(self) -> DataFrame:
        return self.transactions_by_month.drop("TxMonth", "Copies")

    @property
    def tx_months(self) -> DataFrame:
        """Cleaned transactions per month and origin account: rows, ids,
        volume; in a prepared Book a directory per month."""
        from ..plans.chain import aggregate_tx_months

        return self._snapshot("tx_months", lambda: aggregate_tx_months(self), lambda d: self._layout("tx_months", d))

    def append_transactions(self, new: DataFrame) -> None:
        """Add transactions that arrived later (columns as ``transactions``)
        and bring the written snapshot up to date in place: only the months
        that gain, lose or change a row are written again.  The first row of
        an id stays the first across old and new rows; with a source row as
        tie-breaker, new rows count as later ones.  Rollups of transactions
        are rebuilt when next asked for."""
        if self.store is not None and "transactions_clean" in self._cache:
            from ..operators.quality import transaction_order

            order = [c for c in transaction_order(self) if c not in self.tx_tiebreak]
            merge_first(self.store, "transactions_clean", self._dedupe(new), "TransactionID", order,
                        LAYOUTS["transactions_clean"], arrival_decides=bool(self.tx_tiebreak))
        stale = ("transactions_clean", "tx_months", "tx_accounts")
        known = self.store is not None and "transactions_clean" in self._cache
        for name in stale:
            self._cache.pop(name, None)
        if known:
            self._cache["transactions_clean"] = self.store.table("transactions_clean")
        for name in [n for n in self.hot if n.startswith("transactions.")]:
            del self.hot[name]
        self.transactions = self.transactions.unionByName(new)

    def append_customers(self, new: DataFrame) -> None:
        """Add customers that arrived later (new ids): their cleaned rows are
        appended to the written snapshot, bucket by bucket."""
        from ..operators.quality import clean_customers

        if self.store is not None and "customers_final" in self._cache:
            self.store.append_bucketed(clean_customers(replace(self, customers=new, store=None, _cache={})),
                                       "customers_final", "CustomerID")
            self._cache["customers_final"] = self.store.table("customers_final")
        for name in ("account_customers", "customers_final_clustered"):
            self._cache.pop(name, None)
        self.customers = self.customers.unionByName(new)

    @property
    def tx_accounts(self) -> DataFrame:
        """Cleaned transactions per origin account: rows, ids, volume (one
        row per account, bucketed like the account dimension)."""
        from ..plans.chain import aggregate_tx

        return self._snapshot("tx_accounts", lambda: aggregate_tx(self),
                              lambda d: self.store.bucketed(d, "tx_accounts", "AccountID"))

    @property
    def loan_rollup(self) -> DataFrame:
        """Loans added up per (account, status), bucketed like the account
        dimension: what the exposure, solvency, ranking and rate reports read."""
        from ..plans.chain import build_loan_rollup

        return self._snapshot("loan_rollup", lambda: build_loan_rollup(self),
                              lambda d: self.store.bucketed(d, "loan_rollup", "AccountID"))

    @property
    def customers_final(self) -> DataFrame:
        from ..operators.quality import clean_customers

        return self._snapshot("customers_final", lambda: clean_customers(self),
                              lambda d: self.store.bucketed(d, "customers_final", "CustomerID"))

    @property
    def account_customers(self) -> DataFrame:
        """Accounts joined to their (cleaned, typed) customer: the account
        dimension every loan-book report joins on AccountID.  A prepared Book
        writes it once, bucketed on AccountID, so the joins do not move it."""
        from ..plans.chain import build_account_customers

        return self._snapshot("account_customers", lambda: build_account_customers(self),
                              lambda d: self.store.bucketed(d, "account_customers", "AccountID"))
