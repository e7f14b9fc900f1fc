"""Every operator against the direct-join SQL form, on random role tables
with repeated loans, NULL keys, orphans, equal balances and a hot account
holding a third of the loans and transactions."""

from __future__ import annotations

import pytest

from riskbook.compare import diff
from riskbook.oracle import ORACLE, over_roles
from riskbook.registry import BOOK_QUERIES

from .fixtures import duck_over, random_tables, role_book

NAMES = sorted(BOOK_QUERIES)


@pytest.fixture(scope="module", params=[(7, None, False), (2024, 20, False), (99, 20, True)],
                ids=["plain", "hot-split", "prepared"])
def case(spark, request):
    """The second case marks keys with more than 20 rows as hot (an account
    with many loans, a customer with many accounts), so their joins take
    the split (broadcast) path;
    the third also writes the tables with the load layout (catalog tables,
    status partitions, bucketed dimensions) and reads them back."""
    seed, hot_rows, prepare = request.param
    tables = random_tables(seed)
    book = role_book(spark, tables)
    if hot_rows is not None:
        book.hot_key_rows = hot_rows
        book = book.prepared() if prepare else book.find_hot_keys()
        assert book.hot_keys("loans.AccountID").count >= 1
        assert book.hot_keys("accounts.CustomerID").count >= 1
    return tables, book


@pytest.mark.parametrize("name", NAMES)
def test_operator_matches_direct_sql(case, name):
    tables, book = case
    df = BOOK_QUERIES[name](book)
    cols, rows = duck_over(tables, over_roles(ORACLE[name]))
    problem = diff(df.columns, df.collect(), cols, rows)
    assert problem is None, f"{name}: {problem}"
