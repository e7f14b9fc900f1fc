"""The trained operators: held-out accuracy, parts by brute force, odd rows."""

from __future__ import annotations

import os
import random
import zlib
from itertools import product

import numpy as np
import pytest

from riskbook.llm import language_id, quality_model, queries, toxicity

from .helpers import SCHEMA, SF, odd_rows, table

LABELS = "doc_id long, quality int, toxic int"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def held(i, buckets, rest):
    return zlib.crc32(str(i).encode()) % buckets == rest


# -- op1 -----------------------------------------------------------------------

@needs_data
@pytest.mark.parametrize("name,label,buckets,rest,cut", [("op1_quality", "quality", 5, 0, .3),
                                                         ("op4_toxicity", "toxic", 3, 1, .7)])
def test_held_out_accuracy(spark, name, label, buckets, rest, cut):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], buckets, rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    test = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in test]) > .95


def test_rules_are_compiled_as_they_hold(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_model.STATISTICS))).astype(np.float32)
    y = ((x[:, 2] > .6) & (x[:, 4] <= .5)).astype(float)
    model = quality_model.fit(x.astype(float), y)
    assert 0 < len(model.rules) < 200
    z = model.bias + sum(w * quality_model.holds(x, r) for r, w in model.rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} float" for s in quality_model.STATISTICS))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert np.mean((np.array(got) > .5) == y) > .95


def test_lasso_drops_idle_columns():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (800, 30)).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(3 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    w, _ = quality_model.lasso(z, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and np.sum(np.abs(w) > 1e-3) < 12


# -- op4 -----------------------------------------------------------------------

def english():
    words = "you are such an idiot loser the moron of all people stupid scum in this town and what a good day".split()
    return [" ".join(random.Random(i).choices(words, k=40)) for i in range(60)]


def cost_of(texts):
    n = np.full(toxicity.CLASSES ** 3, .1) + toxicity.trigram_counts([t.encode() for t in texts])
    n = n.reshape(-1, toxicity.CLASSES)
    return -np.log(n / n.sum(axis=1, keepdims=True)).ravel()


def test_viterbi_is_the_best_path():
    cost = cost_of(english())
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
    tokens = [(t, None) for t in ("1d10t", "m0r0n", "l0s3r", "st.u.pid", "iddiot", "sc|_|m", "$cum", "stuupid")]
    tokens += [("i d 1 o t", toxicity.APART), ("u i-d i 0 t", toxicity.APART), ("id iot", toxicity.CUT),
               ("good man", toxicity.CUT), ("st uupid", toxicity.CUT)]
    for token, space in tokens:
        best = None
        for path in product(*toxicity.lattice(token, space)):
            state, total = 0, 0.0
            for c, channel in path:
                total += channel
                if c:
                    total += cost[state * 28 + code(c)]
                    state = state % 28 * 28 + code(c)
            total += cost[state * 28]
            word = "".join(c for c, _ in path)
            if best is None or total < best[0] - 1e-12:
                best = (total, word)
        assert toxicity.viterbi(token, cost.tolist(), space) == best[1]


def test_disguised_words_are_restored():
    r = toxicity.Restorer(cost_of(english()))
    assert r.text("you 1d10t and l0s3r, i d i o t of m.o.r.o.n stuuupid $cum!") == (
        "you idiot and loser, idiot of moron stupid scum!")
    assert r.text("plain words, 42 of them (fine)!! a@b.example") .startswith("plain words, 42 of them (fine)!!")


@pytest.mark.parametrize("text,restored", [
    ("i d 1 o t", "idiot"), ("m o r 0 n", "moron"), ("id iot", "idiot"), ("st upid", "stupid"), ("idioot", "idiot"),
    ("stuupid", "stupid"), ("y o u i d i o t", "you idiot"), ("s t u p 1 d l o s e r", "stupid loser"),
    ("you st upid l0ser", "you stupid loser"), ("an i.d.1.o.t and a l-0-s-3-r", "an idiot and a loser"),
    ("such an idiot of all the people in this town", "such an idiot of all the people in this town"),
    ("what a good day", "what a good day"), ("1 2 3 4 5 of all", "1 2 3 4 5 of all")])
def test_mixed_disguises(text, restored):
    assert toxicity.Restorer(cost_of(english())).text(text) == restored


def test_what_a_scorer_skips_would_not_change_the_score():
    """Scores equal those of decoding every doubled letter and every pair of tokens."""
    cost, rng = cost_of(english()), random.Random(6)
    model = toxicity.Model({"idiot": 2.0, "idio-": 1.0, "stupid": 1.5, "asshole": 1.0, "moron": .7, "loser": .3}, -3.0)
    scorer, plain = toxicity.Scorer(model, cost), toxicity.Restorer(cost)
    bits = ["idioot", "stuupid", "st upid", "id iot", "i d 1 o t", "m.o.r.o.n", "loooser", "assshole", "aashoole", "good", "all", "a",
            "lo ser,", "i", "m o r o n!", "tree", "book keeper", "x y", "idiotss", "iidiot"]
    for _ in range(300):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        words = [w for t in text.split() for w in toxicity._WORD.findall(t) + toxicity._WORD.findall(plain.token(t, doubles=True))]
        words += [w for _, run in plain.apart(text) for w in run.split()]
        tokens = text.split()
        pairs = [a + b for a, b in zip(tokens, tokens[1:]) if toxicity._part(a, b) and " " not in plain.joined(a, b)
                 and a + b in model.weights]
        found = {f for w in words + pairs for f in toxicity.word_features(w) if f in model.weights}
        assert scorer.score(text) == pytest.approx(model.score(found)), text


def test_one_repeated_id_does_not_outweigh_the_sample(spark):
    """A labelled id in most rows, with one text and with very many texts."""
    rng = random.Random(8)
    plain = "river stone bird quiet tree house water field road hill".split()
    rows = [(i, " ".join(rng.choices(plain, k=20)) + (" idiot" if i % 3 == 0 else "")) for i in range(120)]
    rows += [(0, "the very same toxic text")] * 2000 + [(3, f"text number {k} of one id") for k in range(2000)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], LABELS)
    got = toxicity.score_toxicity(table(spark, [*rows, (9000, "a road and an idiot")]), labels).collect()
    score = {r["doc_id"]: r["predicted"] for r in got}
    assert score[9000] == 1 and score[1] == 0 and score[2] == 0


def test_disguised_toxic_texts_are_caught(spark):
    rng = random.Random(4)
    plain = "the river runs over stones and birds sing in every quiet tree by some old house near water".split()
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=30)
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "loser"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "the river runs over an 1d10t by some old house"), (1001, "birds sing m o r o n in the tree"),
             (1002, "stones and l000ser water"), (1003, "birds sing in every quiet tree"),
             (1004, "the river runs over an i d 1 o t by the tree"), (1005, "water near an idioot and birds"),
             (1006, "some old id iot near water"), (1007, "some old bird near wa ter")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert [got[i]["predicted"] for i in range(1000, 1008)] == [1, 1, 1, 0, 1, 1, 1, 0]
    assert all(got[i]["predicted"] == t for i, _, t in labels)


# -- op8 -----------------------------------------------------------------------

@needs_data
def test_language_of_held_out_rows(spark):
    rows = queries.QUERIES["op8_language"](spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > .97


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 12])
def test_codewords_are_far_apart(n):
    code = language_id.codewords(n)
    far = min([int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)], default=1)
    assert far >= (2 ** (n - 2) if 2 <= n <= 7 else 1 if n < 8 else 5)


def test_decoding_takes_the_nearest_codeword():
    code = language_id.codewords(4)
    m = language_id.Model(list("abcd"), code, np.zeros((language_id.BUCKETS, 7), np.float32), np.zeros(7), np.ones(7), .2)
    for k in range(4):
        for flip in range(7):
            margin = code[k].astype(float) * 2
            margin[flip] *= -1                            # one wrong bit is corrected
            best, p, close = m.decode(margin[None])
            assert best[0] == k and not close[0]
    assert m.decode(np.zeros((1, 7)))[2][0]               # no margin at all: ambiguous


def test_batch_margins_equal_single_ones():
    rng = np.random.default_rng(2)
    code = language_id.codewords(4)
    m = language_id.Model(list("abcd"), code, rng.normal(size=(language_id.BUCKETS, 7)).astype(np.float32), np.zeros(7), np.ones(7), .2)
    raw = ["", "a", "é", "Some Words 123", "x" * 500, "ñandú"]
    raw = [t.encode() for t in raw]
    alone = np.vstack([language_id.counts([t]) @ m.weights for t in raw])
    assert np.allclose(m.margins(raw), alone, atol=1e-3)


# -- odd rows ------------------------------------------------------------------

def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None)], LABELS)
    df, empty = table(spark, odd_rows()), spark.createDataFrame([], SCHEMA)
    for f in (quality_model.score_quality, toxicity.score_toxicity):
        assert len(f(df, labels).collect()) == len(odd_rows())
        assert {r["score"] for r in f(df, labels.limit(0)).collect()} == {0.5}
        assert f(empty, labels).collect() == []
    got = language_id.identify(df).collect()
    assert len(got) == len(odd_rows())
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.identify(empty).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", df["lang"].cast("string")).filter("lang is null")).collect()} == {"und"}
