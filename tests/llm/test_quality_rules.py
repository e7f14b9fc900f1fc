from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from riskbook.llm import quality_rules as q

from .helpers import SCHEMA, odd_rows, table


def covered(words, k):
    grams = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    got = set()
    for i in range(len(words) - k + 1):
        if grams[tuple(words[i:i + k])] > 1:
            got.update(range(i, i + k))
    return len(got)


def longest(words, least):
    best = 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def brute(text, rules):
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    rep, long, top = covered(words, rules.window), covered(words, rules.long_repeat), longest(words, rules.window)
    failed = len(words) < rules.min_words or 100 * rep > rules.max_repeat_percent * len(words)
    kept = not failed and 100 * long <= rules.max_long_percent * len(words) and top <= rules.longest
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), rep, long, top, failed, kept)


def texts():
    rng = random.Random(3)
    out = ["", None, "a", "a a", "a b a b a b a b a b a b", "x y\n\nx y\n x y\n", "# a|b <c> 50%", "é ñ 😀 b c"]
    for _ in range(150):
        vocab = [f"w{i}" for i in range(rng.choice([1, 2, 4, 30]))]
        out.append(rng.choice([" ", "\n", "\x0b "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60))))
    return out


RULES = [q.RepetitionRules(), q.RepetitionRules(window=3, long_repeat=6, max_repeat_percent=70, max_long_percent=30,
                                                longest=9, min_words=4)]


@pytest.mark.parametrize("rules", RULES)
def test_matches_brute_force(spark, rules):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "n_long_words", "longest_repeat", "base_failed", "kept"))
           for r in q.score_rules(table(spark, rows), rules).collect()}
    assert got == {i: brute(t, rules) for i, t in rows}
    kept = {r["doc_id"] for r in q.keep(table(spark, rows), rules).collect()}
    assert kept == {i for i, t in rows if brute(t, rules)[-1]}


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 200)
    doc = np.repeat(np.arange(4), 50)
    sa, levels = q.suffix_array(ids, doc)
    suffix = lambda i: tuple(ids[i:(doc[i] + 1) * 50])
    assert sorted(range(200), key=lambda i: (doc[i], suffix(i))) == sa.tolist()
    lcp = q.neighbour_lcp(sa, levels, doc, 1)
    for s in range(199):
        a, b = suffix(sa[s]), suffix(sa[s + 1])
        n = 0
        while doc[sa[s]] == doc[sa[s + 1]] and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[s] == n


def test_odd_rows(spark):
    got = q.score_rules(table(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert all(r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3, 5))
    assert q.score_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert q.keep(spark.createDataFrame([], SCHEMA)).columns == SCHEMA.names
