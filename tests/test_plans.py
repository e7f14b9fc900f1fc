"""Plan checks on the prepared loan book: no cartesian products, code
tables broadcast, filters and pruning reach the scan, windows sit above
aggregates, rollups replace loans, and hot keys are salted in one scan."""

from __future__ import annotations

import os
import re

import pytest

from riskbook.plans.inspect import has_cartesian, physical_plan
from riskbook.registry import BOOK_QUERIES, book_for

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="test data not present")


@pytest.fixture(scope="module")
def book(spark):
    return book_for(spark, SF)


def plan(book, name):
    return physical_plan(BOOK_QUERIES[name](book))


@pytest.mark.parametrize("name", sorted(BOOK_QUERIES))
def test_no_cartesian_product(book, name):
    assert not has_cartesian(BOOK_QUERIES[name](book))


ROLLUP_REPORTS = [
    "exposure_by_status", "yield_by_status", "portfolio_scorecard", "exposure_by_segment", "overdue_exposure",
    "debt_per_customer", "liquidity_gap", "debt_to_asset_ratio", "red_flag_list", "segment_default_rate", "segment_rank",
    "branch_default_rank", "vw_portfolio_health", "vw_portfolio_health_overdue", "vw_portfolio_health_sorted",
    "vw_red_flag_customers", "vw_red_flag_enterprise", "vw_red_flag_top5", "vw_segment_rankings", "customers_with_loans",
    "baseline_yield", "rate_scenarios", "rate_deltas", "overdue_ecl", "what_if_plus1", "what_if_minus1", "what_if_plus2",
    "what_if_minus2", "integrity_summary"]


@pytest.mark.parametrize("name", ROLLUP_REPORTS)
def test_rollup_reports_do_not_scan_loans(book, name):
    p = plan(book, name)
    assert "loan_rollup" in p and not re.search(r"\.loans[ \[]", p)


def test_rollup_is_one_aggregate_of_one_scan(book):
    from riskbook.plans.chain import build_loan_rollup
    from riskbook.plans.inspect import count_exchanges

    p = physical_plan(build_loan_rollup(book))
    assert len(re.findall(r"FileScan", p)) == 1 and count_exchanges(build_loan_rollup(book)) == 1
    assert "partial_sum(" in p


def test_status_codes_filter_the_scan_and_prune(book):
    p = plan(book, "customer_loans")
    # the fixed status list is a CASE plus an IN filter on the partition column: no join for it
    assert p.count("Join") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*LoanStatusID#\d+ IN \(1,2,3\)", p)
    scan = [ln for ln in p.splitlines() if "loans" in ln and "Scan" in ln][0]
    assert "StartDate" not in scan                        # only needed columns are read
    scan = [ln for ln in plan(book, "exposure_by_status").splitlines() if "Scan" in ln][0]
    assert "p_rated" not in scan and "LoanStatusID" in scan
    # the aggregate is split: partial before the exchange, final after
    assert "partial_sum(p" in plan(book, "exposure_by_status")


def test_status_filter_prunes_partitions(book):
    p = plan(book, "loans_by_status")
    assert "PartitionFilters: [isnotnull(LoanStatusID" in p and "(LoanStatusID#" in p and "= 2)" in p


def test_dedupe_limits_groups_before_shuffle(book):
    assert "WindowGroupLimit" in plan(book, "dedupe_transactions")


@pytest.mark.parametrize("name", ["portfolio_scorecard", "segment_rank", "branch_default_rank",
                                  "monthly_volume_trend", "running_exposure", "vw_segment_rankings"])
def test_global_windows_run_over_aggregates(book, name):
    p = plan(book, name)
    win = p.index("Window [")
    assert "HashAggregate" in p[win:], "a window over all rows must sit above an aggregate"


def test_segment_report_joins_without_moving_either_side(spark, book):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(book, "exposure_by_segment")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rollup and account dimension are bucketed alike: nothing is shuffled below the join
    assert "Exchange" not in p[p.index("SortMergeJoin"):]


@pytest.fixture()
def hot_book(spark, book):
    """The prepared book with forced hot keys."""
    from riskbook.plans.skew import find_hot_keys

    saved = dict(book.hot)
    for name, df, rows in (("loans.AccountID", book.loans, 5), ("accounts.CustomerID", book.accounts, 5),
                           ("transactions.AccountOriginID", book.transactions_clean, 1)):
        book.hot[name] = find_hot_keys(df, name.split(".")[1], rows, book.store, "forced_" + name.replace(".", "_"))
    assert all(book.hot[k].count for k in ("loans.AccountID", "accounts.CustomerID", "transactions.AccountOriginID"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield book
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    book.hot.clear()
    book.hot.update(saved)


@pytest.mark.parametrize("name,fact", [
    ("customer_loans", "loans"), ("master_portfolio", "loans"), ("loan_transaction_summary", "loans"),
    ("portfolio_slim", "loans"), ("credit_health_score", "loans"), ("orphan_loans", "loans"),
    ("orphan_accounts", "accounts"), ("orphan_transactions_account", "transactions_clean")])
def test_hot_keys_cost_one_scan_and_one_exchange_of_the_fact(hot_book, name, fact):
    p = plan(hot_book, name)
    scans = [ln for ln in p.splitlines() if "Scan" in ln and (f".{fact}[" in ln or f"/{fact}]" in ln or f"/{fact}," in ln
                                                             or (fact == "accounts" and "orders.parquet" in ln))]
    assert "_salt" in p and "Union" not in p
    assert len(scans) == 1
    if name != "credit_health_score":            # it groups loans once more, by customer
        assert _exchanges_above(p, re.search(r"\S*#.*", scans[0].split("Scan", 1)[1]).group(0)) == 1


def test_status_report_shuffles_only_aggregates(book):
    from riskbook.plans.inspect import count_exchanges

    # partial aggregate -> one exchange -> final aggregate, then the ordered output
    assert count_exchanges(BOOK_QUERIES["exposure_by_status"](book)) == 2


def _exchanges_above(plan: str, scan: str) -> int:
    """Exchanges on the path from the first line naming ``scan`` up to the root."""
    lines = plan.splitlines()
    at = next(i for i, ln in enumerate(lines) if scan in ln and "Scan" in ln)

    def depth(ln: str) -> int:
        return len(ln) - len(ln.lstrip(" :|+-"))

    n, level = 0, depth(lines[at])
    for ln in reversed(lines[:at]):
        if depth(ln) < level:
            level = depth(ln)
            n += "Exchange" in ln and "BroadcastExchange" not in ln
    return n


def test_loan_rows_shuffle_once_in_q23(spark):
    from riskbook.operators import portfolio
    from riskbook.sources.book import Book

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = physical_plan(portfolio.loan_transaction_summary(Book.from_driver(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # loans are shuffled once (by account for the join); the report's
    # grouping reuses that partitioning
    assert _exchanges_above(p, "lineitem") == 1


def test_a_hot_key_among_very_many_is_spread(spark, book):
    """However many keys there are, one over an even share is spread."""
    from riskbook.plans.skew import find_hot_keys, salted_join

    fact = spark.range(300_000).selectExpr("IF(id % 3 = 0, -5, id) AS k", "id")
    hot = find_hot_keys(fact, "k")
    assert [r["k"] for r in hot.keys.collect()] == [-5]
    assert hot.keys.first()["_fan"] > 1 and hot.null_fan == 1
    dim = spark.range(-5, 300_000).selectExpr("id AS k", "id * 2 AS twice")
    joined = salted_join(fact, dim, "k", hot)
    assert "_salt" in physical_plan(joined) and joined.columns == ["k", "id", "twice"]
    assert joined.selectExpr("count(*)", "count(distinct id)", "sum(twice - 2 * k)").first() == (300_000, 300_000, 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, how):
    """A hot key, a third of NULL keys, keys without a partner, repeated rows."""
    from riskbook.plans.skew import find_hot_keys, salted_join

    fact = spark.range(3000).selectExpr("CAST(id % 50 AS int) AS x", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 "
                                        "THEN -1 ELSE id END AS k")
    dim = spark.range(-1, 2000).selectExpr("id AS k", "id * 7 AS y").filter("k % 5 != 0")
    hot = find_hot_keys(fact, "k", 100)
    assert hot.count == 1 and hot.null_fan == 10
    def key(r):
        return tuple((v is None, v) for v in r)
    got = sorted(salted_join(fact, dim, "k", hot, how).collect(), key=key)
    assert got == sorted(fact.join(dim, "k", how).collect(), key=key)


def test_salts_follow_the_group_when_an_aggregate_comes_next(spark):
    from pyspark.sql import functions as F

    from riskbook.plans.inspect import count_exchanges
    from riskbook.plans.skew import HotKeys, salted_join

    fact = spark.range(9000).selectExpr("IF(id % 3 = 0, 1, id) AS k", "id % 40 AS g")
    dim = spark.range(9000).selectExpr("id AS k", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = HotKeys(spark.createDataFrame([(1, 3)], "k long, _fan int"), 1)
        out = salted_join(fact, dim, "k", hot, spread_by=["g"],
                          then=lambda rows, more: rows.groupBy("k", "g", *more).agg(F.count("*").alias("n")))
        assert count_exchanges(out) == 2                  # both sides of the join, and no more
        want = fact.groupBy("k", "g").count()
        assert sorted(map(tuple, out.select("k", "g", "n").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orphan_lists_take_null_and_hot_keys_in_one_scan(spark, tmp_path):
    """A forced hot key and a third of NULL keys: one scan, and no task gets
    either whole."""
    from riskbook.operators.integrity import orphans
    from riskbook.plans.skew import find_hot_keys

    spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN -1 ELSE id END AS k") \
        .write.parquet(str(tmp_path / "child"))
    child = spark.read.parquet(str(tmp_path / "child"))
    parent = spark.range(9000).selectExpr("id AS pk").filter("pk > 100")
    hot = find_hot_keys(child, "k")
    assert [r["k"] for r in hot.keys.collect()] == [-1] and hot.null_fan > 1
    df = orphans(child, "k", parent, "pk", ["id", "k"], hot)
    p = physical_plan(df)
    assert len([ln for ln in p.splitlines() if "FileScan" in ln and "child" in ln and "_salt" not in ln
                and "id#" in ln]) == 1
    want = {r["id"] for r in child.collect() if r["k"] is None or r["k"] == -1 or not 100 < r["k"]}
    assert {r["id"] for r in df.collect()} == want


def test_integrity_summary_reads_each_table_once_and_shuffles_keys_once(book):
    p = plan(book, "integrity_summary")
    for name in ("loan_rollup", "transactions_clean", "customers_final"):
        assert len([ln for ln in p.splitlines() if "Scan" in ln and f".{name}[" in ln]) == 1, name
    assert "Anti" not in p
    assert len(re.findall(r"Exchange hashpartitioning\(relationship#\d+, key#", p)) == 1


def test_bucketed_tables_have_one_file_a_bucket_and_are_not_shuffled(spark, book):
    dim = book.account_customers
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dim.selectExpr("input_file_name() AS f").distinct().count() <= n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(book, "exposure_by_segment")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in p
    assert _exchanges_above(p, "account_customers") == 2          # the report's aggregate and order, not the join


def test_month_filter_prunes_directories(book):
    p = plan(book, "top_accounts_by_volume")
    assert "PartitionFilters: [isnotnull(TxMonth" in p and ">= 2024-01" in p


@pytest.mark.parametrize("name", ["credit_health_score", "loan_transaction_summary"])
def test_transactions_are_reduced_once(book, name):
    p = plan(book, name)
    assert p.count("tx_accounts") >= 1 and "transactions_clean" not in p


def _files_read(spark, df) -> dict[str, int]:
    """Files opened per scanned table, from the metrics of an executed plan
    (they count before other buckets are left out; a bucket is one file)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        execution.executedPlan().executeCollect()
        leaves, found = execution.executedPlan().collectLeaves(), {}
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.metrics().contains("numFiles"):
                table = leaf.nodeName().rsplit(".", 1)[-1]
                files, buckets = int(leaf.metrics().apply("numFiles").value()), leaf.optionalBucketSet()
                if buckets.isDefined():
                    files = min(files, buckets.get().cardinality())
                found[table] = found.get(table, 0) + files
        return found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_customer_opens_few_files(spark):
    from riskbook.operators.scoring import credit_health_score
    from riskbook.sources.book import Book

    spark.conf.set("spark.sql.shuffle.partitions", "128")
    try:
        book = Book.from_driver(spark, SF).prepared().load()
        one = _files_read(spark, credit_health_score(book, 7))
        everyone = _files_read(spark, credit_health_score(book))
        want = [r for r in credit_health_score(book).collect() if r["CustomerID"] == 7]
        assert credit_health_score(book, 7).collect() == want and want
        # a customer over the bound of accounts takes the semi joins, with the same result
        assert book.accounts_of(7, most=0) is None
        assert sorted(book.loans_of(book.accounts_of(7), most=0).collect(), key=str) == \
            sorted(book.loans_of(book.accounts_of(7)).collect(), key=str)
        book.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert everyone["loans"] >= 100 and one["loans"] <= everyone["loans"] / 3
    assert one["tx_accounts"] <= everyone["tx_accounts"] / 3
    assert one["account_customers"] <= everyone["account_customers"] / 3


def test_layouts_bound_their_files(spark):
    """Ranges over directories and keys: no product of both, and a directory
    with most rows still has several files."""
    from riskbook.plans.materialize import Store

    rows = spark.range(20_000).selectExpr("IF(id % 10 < 7, 0, CAST(id % 10 AS int)) AS d", "id % 900 AS k", "id AS v")
    store = Store(spark)
    try:
        df = store.layout(rows, "t", ["d"], ["k", "v"])
        files = df.selectExpr("d", "input_file_name() AS f").distinct().collect()
        assert len(files) <= 8 + 4 and len({r["d"] for r in files}) == 4
        assert sum(r["d"] == 0 for r in files) >= 4
        assert df.count() == 20_000
    finally:
        store.drop()


def test_no_job_while_a_loaded_book_plans(spark, book):
    book.load()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    for name in sorted(BOOK_QUERIES):
        if not name.startswith("clustered") and name != "credit_health_score_one":    # that one looks up its accounts
            BOOK_QUERIES[name](book)
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext._jsc.clearJobGroup()
