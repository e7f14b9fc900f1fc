from __future__ import annotations

import math
import random

import pytest

from riskbook.llm import decontaminate as d

from .helpers import SCHEMA, odd_rows, table


def bench(spark, items):
    return spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")


def scores(items, passage, k1=1.2, b=0.75):
    """BM25 of every item against a passage, scaled by the item against itself."""
    docs = [d.terms(t) for _, t in items]
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for w in docs:
        whole = part = 0.0
        for t in set(w):
            df = sum(t in x for x in docs)
            tf = w.count(t)
            x = math.log(1 + (len(docs) - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
            whole += x
            part += x * (t in passage)
        out.append(part / whole)
    return out


def items(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["the", "of"] * 15
    return [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 25)))) for i in range(n)], vocab, rng


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_wand_finds_all_above_the_threshold(spark, threshold):
    rows, vocab, rng = items(3)
    (index,) = list(d.indexes(bench(spark, rows)))
    for _ in range(120):
        passage = {rng.choice(vocab) for _ in range(rng.randint(1, 40))} | set(rng.choice(rows)[1].split()[:rng.randint(0, 25)])
        got = {index.ids[i]: s for i, s in index.search(sorted(index.words[w] for w in passage if w in index.words), threshold)}
        want = {str(rows[i][0]): s for i, s in enumerate(scores(rows, passage)) if s >= threshold - 1e-9}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_planted_items_are_found_and_clean_texts_left(spark, monkeypatch):
    rows, vocab, rng = items(4)
    docs, want = [], set()
    for i in range(150):
        words = [rng.choice([f"c{k}" for k in range(300)] + ["the", "of"]) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            item, text = rng.choice(rows)
            at = rng.randint(0, len(words))
            words[at:at] = text.upper().split() if i % 2 else f"\"{text}\",".split()
            want.add((i, str(item)))
        docs.append((i, " ".join(words)))
    got = d.find_leaks(table(spark, docs), bench(spark, rows)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    clean = {r["doc_id"] for r in d.drop_leaks(table(spark, docs), bench(spark, rows)).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}
    monkeypatch.setattr(d, "SHARD_BYTES", 300)                     # many shards: the same result
    again = d.find_leaks(table(spark, docs), bench(spark, rows)).collect()
    key = lambda rs: {(r['doc_id'], r['item_id'], round(r['score'], 9)) for r in rs}
    assert key(again) == key(got)


def test_question_without_its_answer_is_no_leak(spark):
    text = " ".join(f"q{i}" for i in range(20)) + " " + " ".join(f"a{i}" for i in range(10))
    other = (2, "some other item of words")
    half = " ".join(f"q{i}" for i in range(20)) + " and then nothing"
    found = d.find_leaks(table(spark, [(1, half), (2, text)]), bench(spark, [(1, text), other]), threshold=0.5)
    assert [r["doc_id"] for r in found.collect()] == [2]


def test_odd_rows(spark):
    b = bench(spark, [(1, None), (2, ""), (3, "some words without an id"), (3, "some words without an id"),
                      (4, "some words without an id"), (None, "one")])
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(table(spark, odd_rows()), b).collect()}
    assert got == {(None, "3"), (None, "4"), (5, None)}
    assert d.find_leaks(spark.createDataFrame([], SCHEMA), b).collect() == []
    nothing = b.limit(0)
    assert d.find_leaks(table(spark, odd_rows()), nothing).collect() == []
    assert d.drop_leaks(table(spark, odd_rows()), nothing).count() == len(odd_rows())


def brute(docs, rows, threshold, question, answer):
    """Every passage of every document against every item."""
    split = [d.terms(t) for _, t in rows]
    span = max(map(len, split))
    found = {}
    for doc, text in docs:
        words = d.terms(text)
        halves = max(1, -(-len(words) // span))
        for h in range(halves):
            if h and h == halves - 1:
                continue
            passage = words[h * span:h * span + 2 * span]
            reach = scores(rows, set(passage))
            for k, (item, _) in enumerate(rows):
                if reach[k] < threshold - 1e-9:
                    continue
                cut, shares = (2 * len(split[k]) + 2) // 3, []
                for part in (split[k][:cut], split[k][cut:]):
                    n = min(3, len(part))
                    grams = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)} if n else set()
                    held = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
                    shares.append(len(grams & held) / len(grams) if grams else 1.0)
                if shares[0] >= question and shares[1] >= answer and reach[k] > found.get((doc, item), (0,))[0] + 1e-9:
                    found[doc, item] = (reach[k], *shares, h * span)
    return found


@pytest.mark.parametrize("limits", [(0.6, 0.6, 0.5), (0.3, 0.2, 0.1), (0.5, 1.0, 0.0), (0.6, 0.0, 0.5)])
def test_whole_query_matches_brute_force(spark, limits):
    """Items in part and in pieces, at passage edges, under ids that are no
    numbers, with terms beyond ASCII."""
    rng = random.Random(sum(limits))
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "ΣΑΣ", "İx", "日本", "e\u0301a", "the", "of"] * 4
    rows = [(f"qa-{i}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 20)))) for i in range(25)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
            part = rng.choice(rows)[1].split()
            words += part[rng.randint(0, 2):len(part) - rng.randint(0, 3)]
        docs.append((i, rng.choice([" ", ", ", " - ", "\n"]).join(words).swapcase()))
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"], r["first_word"])
           for r in d.find_leaks(table(spark, docs), bench(spark, rows), *limits).collect()}
    want = brute(docs, rows, *limits)
    assert got.keys() == want.keys() and want
    for k in want:
        assert got[k] == pytest.approx((min(1.0, want[k][0]), *want[k][1:]), abs=1e-9)


def test_word_hashes_tell_terms_apart_and_do_not_depend_on_pieces(monkeypatch):
    texts = ["one two, TWO\nthree".lower(), "", "ünï two", "...", "one" * 50 + " x " * 40]
    whole, owner = d.word_hashes(texts)
    terms = [t for x in texts for t in d.terms(x)]
    assert len(set(whole.tolist())) == len(set(terms)) and len(whole) == len(terms)
    assert owner.tolist() == [i for i, x in enumerate(texts) for _ in d.terms(x)]
    monkeypatch.setattr(d, "PIECE", 9)
    cut, of = d.word_hashes(texts)
    assert cut.tolist() == whole.tolist() and of.tolist() == owner.tolist()
