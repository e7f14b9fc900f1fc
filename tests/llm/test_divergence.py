"""Source divergence against whole-number arithmetic in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from riskbook.llm import divergence

from .helpers import odd_rows, table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    """The rows of ``audit`` by the definition, from (doc_id, text, lang, source)."""
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        n[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in in_docs[lang].items() if d >= min_docs]
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)

        def p(count, size):
            return 1 + 1_000_000_000 * (count + 2) // (size + 2 * len(kept))

        whole = sum((n[lang, s] for s in sources), Counter())
        size = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        total = sum(whole[t] for t in kept)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pair = [(sum(f(p(n[lang, s][t], size[s]), p(n[lang, o][t], size[o])) for t in kept), o)
                    for o in sources if o != s]
            term = [(f(a, b), t) for t in kept if n[lang, s][t]
                    for a, b in [(p(n[lang, s][t], size[s]), p(whole[t], total))] if a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


WORDS = "Ähre über naïve Apple apple x日本 foo-bar don't 12three МИР мир zebra z".split()
MIXED = [(i, " ".join(WORDS[(i * k) % 13] for k in range(1, 9)), ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None)
         for i in range(60)] + [(None, "apple apple", "en", "s1"), (3, "only here", "xx", "lonely"), (4, "", "xx", "other"),
                                (5, None, "yy", None)]


@pytest.mark.parametrize("bits", [64, 3])
def test_matches_brute_force(spark, bits):
    """With digests of 3 bits every digest is shared and has to be split."""
    assert rows_of(divergence.audit(table(spark, MIXED), 3, 4, bits)) == brute(MIXED, 3, 4)


def test_ties_at_the_last_rank_go_by_item(spark):
    rows = [(i, "b a d c é z", "en", "s") for i in range(3)] + [(9, "z z z z z z", "en", "t")] * 3
    got = rows_of(divergence.audit(table(spark, rows), 3, 2))
    assert got == brute(rows, 3, 2)
    assert [r[3] for r in got if r[:3] == ("en", "s", "term")] == ["a", "b"]


def test_odd_rows_and_a_hot_source(spark):
    rows = [(*r, *(None,) * (4 - len(r))) for r in odd_rows()]
    rows += [(100 + i, "common words of the hot source", "en", "hot") for i in range(50)]
    assert rows_of(divergence.audit(table(spark, rows), 2, 10)) == brute(rows, 2, 10)


def test_empty_table_and_no_kept_term(spark):
    assert rows_of(divergence.audit(table(spark, []).limit(0), 2, 3)) == []
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b")]
    assert rows_of(divergence.audit(table(spark, rows), 2, 3)) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_do_not_depend_on_how_often_a_task_hands_on(monkeypatch):
    texts = [" ".join(WORDS[:k % 13 + 1]).encode() for k in range(200)]

    def counted(step):
        counts, found = divergence._Counts(64), Counter()

        def hand_on():
            for b in counts.rows(named=True):
                for r in b.to_pylist():
                    for s, n in zip(r["s"] or [], r["n"] or []):
                        found[r["l"], s, r["term"]] += n
                    found[r["l"], r["term"]] += r["docs"] or 0
            counts.clear()

        for k in range(0, 200, step):
            counts.add([k // 100] * step, [(k + j) % 3 for j in range(step)], texts[k:k + step])
            if counts.full():
                hand_on()
        hand_on()
        return +found

    whole = counted(100)
    monkeypatch.setattr(divergence, "_TERMS", 5)
    monkeypatch.setattr(divergence, "_PAIRS", 8)
    assert counted(10) == whole


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    text = "Alpha beta-gamma, δέλτα  epsilonzetaeta theta".encode()
    pieces = list(divergence._terms(text))
    assert len(pieces) > 3 and sum(pieces, []) == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]


def test_probabilities_are_exact_beyond_64_bits():
    import numpy as np

    big = [(12_345_678_901, 10 ** 13, 10 ** 6), (5, 10 ** 9, 7), (9_223_372_034, 9_223_372_040, 1), (0, 0, 1)]
    got = divergence.probability(*(np.array(x, np.int64) for x in zip(*big)))
    assert got.tolist() == [1 + 10 ** 9 * (n + 2) // (s + 2 * v) for n, s, v in big]


def test_pair_sums_in_tiles(spark, monkeypatch):
    """More sources than a tile holds, and sums handed on early."""
    import numpy as np

    rng = np.random.default_rng(3)
    p, q = rng.integers(1, 10 ** 9, (50, 23)), rng.integers(1, 10 ** 9, 50)
    monkeypatch.setattr(divergence, "_TILE", 5)
    monkeypatch.setattr(divergence, "_CELLS", 40)
    found, sums, terms = divergence._Scores(3), Counter(), defaultdict(list)
    for a in range(0, 50, 7):
        part = np.zeros(len(p[a:a + 7]), np.int64)
        for b in [*found.add(4, p[a:a + 7], q[a:a + 7], p[a:a + 7] > 0, np.arange(50)[a:a + 7], part), *found.pairs()]:
            for r in b.to_pylist():
                if r["j"] is None:
                    terms[r["i"]].append((r["value"], r["digest"]))
                else:
                    sums[r["i"], r["j"]] += r["value"]
    f = lambda x, y: int((x - y) ** 2 // (x + y))       # noqa: E731
    assert sums == {(i + 1, j + 1): sum(f(int(r[i]), int(r[j])) for r in p) for i in range(23) for j in range(i + 1, 23)}
    for s in range(23):
        want = sorted(((f(int(p[t, s]), int(q[t])), t) for t in range(50) if p[t, s] > q[t]), reverse=True)[:3]
        assert sorted(terms[s + 1], reverse=True)[:3] == want
