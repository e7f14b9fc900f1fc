from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import pytest

from riskbook.llm import exact_repeats

from .helpers import SCHEMA, odd_rows, table


def brute(rows, length):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha256(kept).hexdigest()))
    return Counter(out)


def corpus(rng, vocab):
    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    passages = [text(rng.randint(4, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            if rng.random() < .5 and p:
                p[rng.randrange(len(p))] = rng.choice(vocab)
            parts += [" ".join(p[rng.randint(0, 2):]), text(rng.randint(0, 12))]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(3)] + [(110, ("é" + rows[5][1])[:150]), (111, "ab" * 200), (112, None)]
    return rows


@pytest.mark.parametrize("seed,length,group", [(1, 40, 4096), (2, 200, 4096), (3, 40, 2), (4, 30, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, length, group):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(50)]
    rows = corpus(rng, vocab)
    monkeypatch.setattr(exact_repeats, "GROUP", group)
    got = Counter(tuple(r) for r in exact_repeats.remove_repeats(table(spark, rows), length).collect())
    assert got == brute(rows, length)


def test_repeats_within_one_text_and_kept_bytes(spark):
    p = " ".join(f"passage{i}" for i in range(30))
    rows = [(1, f"{p} middle {p} end"), (2, "short")]
    got = {r["doc_id"]: r for r in exact_repeats.remove_repeats(table(spark, rows), 200, keep_text=True).collect()}
    assert bytes(got[1]["kept"]).endswith(b"end") and got[1]["n_spans"] == 2 and got[1]["n_removed"] > 500
    assert bytes(got[2]["kept"]) == b"short"


def test_odd_rows(spark):
    rows = odd_rows()
    got = Counter(tuple(r) for r in exact_repeats.remove_repeats(table(spark, rows), 200).collect())
    first = {(i, n): (gone, spans) for (i, n, gone, spans, _) in got}
    assert sum(got.values()) == len(rows)
    long = len(next(t for i, t, *_ in rows if i == 4).encode())
    assert first[4, long] == (long, 1) and first[7, 60_000] == (60_000, 1) and first[None, 0] == (0, 0)
    assert exact_repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_without_id_whose_short_hashes_collide_stay_apart(spark):
    """Two texts with one 32-bit hash: the repeats of the first are not cut out of the second."""
    passage = " ".join(f"passage{i}" for i in range(30))
    rows = [(None, f"{passage} 2437"), (None, " ".join(f"alone{i}" for i in range(20)) + " 299299"),
            (None, f"{passage} 9819"), (None, " ".join(f"alone{i}" for i in range(20)) + " 121317"),
            (1, " ".join(f"other{i}" for i in range(40)))]
    df = table(spark, rows)
    h = [r[0] for r in df.selectExpr("hash(doc_id, text)").collect()]
    assert h[0] == h[1] and h[2] == h[3]
    for some in (rows, [rows[0], rows[1], (1, f"x {passage}")]):
        got = Counter(tuple(r) for r in exact_repeats.remove_repeats(table(spark, some), 100).collect())
        assert got == brute(some, 100)


@pytest.mark.parametrize("unit", ["x", "ab", "abc ", "é", "one two three four five six seven eight nine ten, "])
def test_a_repeated_period_is_a_few_rows(unit):
    raw = (unit * (40_000 // len(unit))).encode()
    s = exact_repeats.stretches([b"a start " + raw + b" an end", raw], 200, exact_repeats._Powers())
    assert len(s["lo"]) < 40 and s["times"].sum() > 400 // len(unit)
    for d, n in ((0, len(raw) + 15), (1, len(raw))):             # every suffix is in one entry
        covered = sorted((lo, hi) for lo, hi, of in zip(s["lo"].tolist(), s["hi"].tolist(), s["doc"].tolist()) if of == d)
        assert covered[0][0] == 0 and covered[-1][1] == n - 200
        assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))


def test_periods_match_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        unit = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 30)))
        rows.append((i, "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) + unit * rng.randint(1, 20)
                     + "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60)))))
    rows += [(90, rows[3][1]), (91, "x" * 500), (92, "y" + "x" * 300)]
    got = Counter(tuple(r) for r in exact_repeats.remove_repeats(table(spark, rows), 30).collect())
    assert got == brute(rows, 30)


def test_a_million_equal_bytes_and_a_passage_in_a_third_of_the_rows(spark):
    rng = random.Random(13)
    passage = " ".join(f"passage{i}" for i in range(30))
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(300)]
    rows = [(i, f"{t} {passage} {t[::-1]}" if i % 3 == 0 else t) for i, t in enumerate(own)]
    got = Counter(tuple(r) for r in exact_repeats.remove_repeats(table(spark, rows), 100).collect())
    assert got == brute(rows, 100)
    big = [(1, "x" * 1_000_000), (2, "a quiet text " + "y" * 150)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in exact_repeats.remove_repeats(table(spark, big), 200).collect()}
    assert got == {1: (1_000_000, 1), 2: (0, 0)}
