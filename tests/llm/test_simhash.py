from __future__ import annotations

import random

import pytest
import xxhash

from riskbook.llm import simhash
from riskbook.llm.graph import components

from .helpers import SCHEMA, odd_rows, table


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words)] if 0 < len(words) <= k else [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, most):
    """Component ids by comparing all pairs."""
    root = dict(fps)
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (root[a] ^ root[b]).bit_count() <= most and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


@pytest.mark.parametrize("most", [0, 1, 2])
def test_links_close_all_near_pairs(spark, most):
    rng = random.Random(most)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    fps = set(seeds)
    for s in seeds:
        x = s
        for _ in range(rng.randint(0, 8)):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(df, most)
    for r in edges.collect():
        assert r["a"] < r["b"] and ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= most
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = groups({signed(x): x for x in fps}, most)
    assert {x: got.get(x, x) for x in want} == want


def test_a_hub_is_spread_over_tasks(spark, monkeypatch):
    """A star of 3,000 nodes, its centre the smallest or the largest, and a chain on it."""
    from riskbook.llm import graph

    monkeypatch.setattr(graph, "HUB", 50)
    edges = [(0, i) for i in range(1, 3000)] + [(9000, i) for i in range(5000, 8000)] + [(2999, 4000), (4000, 4001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, 4000: 0, 4001: 0, **{i: 5000 for i in range(5000, 8000)}, 9000: 5000}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1501)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(12):
        words = [rng.choice(vocab) for _ in range(120)]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 1)):
                copy[rng.randrange(120)] = rng.choice(vocab)
            k += 1
            rows.append((k * 7 % 101, " ".join(copy) if rng.random() < .7 else "  ".join(copy).upper()))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "É é ñ x"), (505, " ")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in
           simhash.near_duplicates(table(spark, rows)).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    label = groups(fps, 2)
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}
    kept = {r["doc_id"] for r in simhash.drop_copies(table(spark, rows)).collect()}
    assert kept == {i for i in label if label[i] == i}


def test_odd_rows(spark):
    df = table(spark, odd_rows())
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(odd_rows())
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {1, 2, 3, None} and {r["component_id"] for r in zero} == {1}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = simhash.drop_copies(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 2 not in ids and 1 in ids


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Copies without id, texts that share an id, and an id of which one text alone is a copy."""
    rng = random.Random(3)
    text = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(6)]
    rows = ([(None, text[0])] * 5 + [(7, text[1]), (7, text[2]), (7, text[2]), (None, text[2])]
            + [(2, text[3]), (9, text[3]), (9, text[4]), (None, text[5]), (None, None), (8, ""), (9, None)])
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_copies(table(spark, rows)).collect()), key=str)
    want = [(None, text[0]), (7, text[1]), (7, text[2]), (2, text[3]), (9, text[4]), (None, text[5]), (8, "")]
    assert kept == sorted(want, key=str)
