"""Mixing: targets, quotas, the splitting tree, and the draws."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskbook.llm import mixing
from riskbook.plans.inspect import physical_plan

from .helpers import odd_rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, most=3, cycle=(1, 2, 3)):
    """Reshares the excess round by round; ``sizes`` by source, None last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in free)
        share = {s: Fraction(rest * weight[s], w) for s in free}
        over = {s: Fraction(most * sizes[s]) for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {**full, **share}
        full |= over
        if len(full) == len(names):
            return full


def rows_of(n=400):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range((i * 37) % 900)), "en", "hot" if i % 3 else f"s{i % 11}")
            for i in range(n)]
    return rows + [(900 + i, "rare words here", "en", None) for i in range(4)]


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.mix(table(spark, rows_of()), block_words=16, shard_words=5_000)


def test_targets_and_taken(spark, mixed):
    got = mixing.taken(mixed).collect()
    sizes = Counter()
    for _, text, _, source in rows_of():
        sizes[source] += len(WORD.findall(text))
    want, words = targets(sizes), Counter()
    assert len(got) == len(rows_of())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        words[r["source"]] += r["taken"]
    for s, t in want.items():
        assert words[s] == math.floor(t), s
    assert float(sum(want.values())) == pytest.approx(sum(sizes.values()))
    assert any(t == 3 * sizes[s] for s, t in want.items()) and any(t < 3 * sizes[s] for s, t in want.items())


def test_draws_are_disjoint_shuffled_and_balanced(mixed):
    draws = mixed.draws.collect()
    assert len({(d["row"], d["pass"], d["first_word"]) for d in draws}) == len(draws)
    places = defaultdict(list)
    for d in draws:
        places[d["shard"]].append(d["place"])
    n = len(places)
    assert n > 8 and n & (n - 1) == 0 and set(places) == set(range(n))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = [len(p) for p in places.values()]
    assert max(sizes) - min(sizes) <= 1
    source = {r["row"]: r["source"] for r in mixed.rows.collect()}
    hot = Counter(d["shard"] for d in draws if source[d["row"]] == "hot")
    share = sum(hot.values()) / len(draws)
    for shard, p in places.items():
        spread = math.sqrt(len(p) * share * (1 - share))
        assert abs(hot[shard] - share * len(p)) < 6 * spread + 1
    first = [d["shard"] for d in sorted(draws, key=lambda d: (d["row"], d["pass"], d["first_word"]))]
    assert first != sorted(first)


def test_quotas_add_up(spark):
    quotas = [10 ** 9, 12_345, 0, 1, 777_777]
    df = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    leaves = [r["quotas"] for r in mixing.split_quotas(df, 7, "x").orderBy("shard").collect()]
    assert len(leaves) == 128
    assert [sum(q) for q in zip(*leaves)] == quotas
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 1
    assert all(q >= 0 for leaf in leaves for q in leaf)


@pytest.mark.parametrize("population,marked,draws", [(20, 7, 10), (50, 3, 25), (9, 9, 4), (30, 0, 15), (40, 39, 20), (1, 1, 0)])
def test_hypergeometric_inverts_the_exact_distribution(spark, population, marked, draws):
    us = [k / 97 for k in range(97)]
    df = spark.createDataFrame([(population, marked, draws, u) for u in us], "n long, k long, d long, u double")
    got = [r[0] for r in df.select(mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u"))).collect()]
    weight = [math.comb(marked, x) * math.comb(population - marked, draws - x) if draws >= x else 0
              for x in range(marked + 1)]
    total, want = sum(weight), []
    for u in us:
        x, upto = 0, weight[0]
        while Fraction(upto, total) <= Fraction(u).limit_denominator(10 ** 6):
            x += 1
            upto += weight[x]
        want.append(x)
    assert sum(a != b for a, b in zip(got, want)) <= 1       # a u on the very edge may round either way


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = rows_of(120) + rows_of(30)                         # repeated rows
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]

    def run(docs):
        done = mixing.taken(mixing.mix(docs, block_words=16, shard_words=2_000))
        return sorted((tuple(r) for r in done.select(*columns).collect()), key=str)

    assert run(table(spark, rows)) == run(table(spark, rows[::-1]).repartition(5))


def test_shard_texts_hold_the_taken_words(spark, mixed):
    docs = table(spark, rows_of())
    got = mixing.shard_texts(docs, mixed).collect()
    assert len(got) == mixed.draws.count()
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixed).collect()}
    words, texts = Counter(), dict((r[0], WORD.findall(r[1])) for r in rows_of())
    for r in got:
        words[r["doc_id"]] += len(r["text"].split())
        assert set(r["text"].split()) <= set(texts[r["doc_id"]])
    assert all(words[d] == t for d, t in taken.items())


def test_odd_rows_and_clashing_names(spark):
    docs = table(spark, [(*r, *(None,) * (4 - len(r))) for r in odd_rows()]).withColumn("size", F.lit("x")) \
        .withColumn("target", F.lit("y")).withColumn("i", F.lit(0))
    got = mixing.taken(mixing.mix(docs, block_words=64, shard_words=10_000)).collect()
    assert len(got) == len(odd_rows())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
    assert all(t == math.floor(goal) for t, goal in per.values())


def test_nothing_to_mix(spark):
    assert mixing.taken(mixing.mix(table(spark, []).limit(0))).collect() == []
    got = mixing.taken(mixing.mix(table(spark, [(1, None, None, "a"), (2, "", None, None)]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plans(mixed):
    for df in (mixed.rows, mixed.draws, mixing.taken(mixed)):
        assert "Python" not in physical_plan(df) and "Arrow" not in physical_plan(df)
