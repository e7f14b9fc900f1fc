"""Hand-made role tables for edge cases and brute-force equivalence.

``role_book`` builds a Book from plain rows; ``duck_over`` runs oracle SQL
in DuckDB over the very same rows, so each Spark operator is compared with
the direct-join SQL form on inputs with repeated loans, NULL keys, orphans,
equal balances and one hot account.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
from pyspark.sql import types as T

from riskbook.sources import schemas
from riskbook.sources.book import Book

_ARROW = {
    "LongType()": pa.int64(),
    "IntegerType()": pa.int32(),
    "StringType()": pa.string(),
    "DateType()": pa.date32(),
    "TimestampNTZType()": pa.timestamp("us"),
    "DecimalType(18,2)": pa.decimal128(18, 2),
    "DecimalType(5,4)": pa.decimal128(5, 4),
}


def _arrow_schema(schema, extra=()):
    fields = [pa.field(f.name, _ARROW[repr(f.dataType)]) for f in schema.fields]
    fields += [pa.field(n, pa.int64()) for n in extra]
    return pa.schema(fields)


def role_book(spark, tables: dict[str, list[tuple]]) -> Book:
    frames = {}
    for name, rows in tables.items():
        schema = schemas.BY_NAME[name]
        if name == "transactions":
            schema = T.StructType([*schema.fields, T.StructField("SourceRow", T.LongType())])
        frames[name] = spark.createDataFrame(rows, schema)
    return Book.from_frames(spark, **frames)


def duck_over(tables: dict[str, list[tuple]], sql: str):
    con = duckdb.connect()
    for name in ("customers", "accounts", "loans", "transactions", "branches"):
        rows = tables.get(name, [])
        extra = ("SourceRow",) if name == "transactions" else ()
        sch = _arrow_schema(schemas.BY_NAME[name], extra)
        cols = list(zip(*rows)) if rows else [[] for _ in sch]
        t = pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, sch)], schema=sch)
        con.register(f"{name}_arrow", t)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_arrow")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return cols, res.fetchall()


def d2(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def random_tables(seed: int, n_cust: int = 40, n_acct: int = 90, n_loans: int = 400, n_tx: int = 300):
    """Random role tables with every defect the analysis has to survive."""
    rnd = random.Random(seed)
    names = ["Ann", "Bo", "", "   ", None, " Cy ", "\tDee"]
    customers = [
        (i, rnd.choice(names), rnd.choice(["Lee", "Ng", "", None]), None if i % 7 == 0 else dt.date(1980, 1, 1),
         i % 5, rnd.choice([1, 1, 2, 3, 3, 99]))
        for i in range(1, n_cust + 1)
    ]
    balances = [d2(0), d2(100), d2(250.5), d2(1000), d2(-20)]
    # customer 1 owns about a third of the accounts
    accounts = [
        (1000 + j, 1 if rnd.random() < 0.33 else rnd.choice([*range(1, n_cust + 1), -1, None]),
         rnd.choice([1, 2, 3, 4, 5, 9]), rnd.choice([1, 2, 3, 9]), rnd.choice(balances))
        for j in range(n_acct)
    ]
    hot = 1000  # one account holds about a third of the loans and transactions
    start = dt.datetime(2021, 1, 1)
    loans = []
    for k in range(n_loans):
        acct = hot if rnd.random() < 0.33 else rnd.choice([*range(1000, 1000 + n_acct), -5])
        rate = rnd.choice([Decimal("0.0000"), Decimal("0.0450"), Decimal("0.0500"), Decimal("0.0999"),
                           Decimal("0.1000"), None])
        sd = None if rnd.random() < 0.05 else start + dt.timedelta(days=rnd.randrange(0, 900))
        ed = None if sd is None or rnd.random() < 0.05 else sd + dt.timedelta(days=rnd.randrange(-40, 700))
        row = (5000 + k, acct, rnd.choice([1, 1, 2, 3, 9, None]), d2(rnd.randrange(100, 90000) / 7), rate, sd, ed)
        loans.append(row)
        if rnd.random() < 0.05:
            loans.append(row)  # repeated loan row
    loans.append((None, 1001, 1, d2(10), Decimal("0.05"), start, start))  # loan without id
    tx = []
    for e in range(n_tx):
        acct = hot if rnd.random() < 0.33 else rnd.choice([*range(1000, 1000 + n_acct), -1])
        tid = None if rnd.random() < 0.03 else (e // 2 if rnd.random() < 0.2 else 100000 + e)
        ts = None if rnd.random() < 0.03 else start + dt.timedelta(hours=rnd.randrange(0, 24 * 400))
        tx.append((tid, acct, acct + 1, rnd.choice([1, 2, 3, 4]), d2(rnd.randrange(1, 5000) / 3), ts,
                   rnd.choice([1, 2, 3, 51]), "x", e))
    branches = [(b, f"Branch {b}", b * 10) for b in range(1, 51)]
    return {"customers": customers, "accounts": accounts, "loans": loans, "transactions": tx,
            "branches": branches}
