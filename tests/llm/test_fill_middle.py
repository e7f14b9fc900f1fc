"""Fill-in-the-middle against slicing whole texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskbook.llm import fill_middle as fim

from .helpers import odd_rows, table


def plain(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def some_texts(k=300):
    rng = random.Random(5)
    shared = "".join(rng.choice("abc déf 日本 😀\n<") for _ in range(900))
    texts = ["", "x", "<P", "<P>", "a" * 20_000, "é" * 9_001, "ab" * 7_000, shared]
    for _ in range(k):
        own = "".join(rng.choice("abcdefghij klmno éß 漢字 😀 <>PSM") for _ in range(rng.randrange(2_000)))
        texts.append(own[:500] + shared + own[500:] if rng.random() < 0.5 else own)
    return texts


def test_chunks_cover_the_text_and_end_at_code_points():
    for text in some_texts():
        raw, last = text.encode(), 0
        ends = fim.chunk_ends(raw)
        for end in ends:
            raw[last:end].decode()
            assert end - last <= fim._MOST and (end - last >= fim._LEAST or end == len(raw))
            last = end
        assert last == len(raw)


def test_shared_passages_are_chunked_alike():
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    one, two = b"one " * 50 + passage, b"another start" * 33 + passage + b" and an end"
    cache: dict = {}
    fim.Chunks(one, cache)
    known = len(cache)
    fim.Chunks(two, cache)
    assert len(cache) - known < known / 4


@pytest.mark.parametrize("rate,spm", [(90, 20), (100, 100), (100, 0), (0, 50)])
def test_rewrites_match_slices(rate, spm):
    cache: dict = {}
    for i, text in enumerate(some_texts()):
        got = fim.rewrite(i, text.encode(), cache, 1, rate, spm)
        assert (*got[:4], got[4].decode()) == plain(i, text, 1, rate, spm)


@pytest.mark.parametrize("tag", ["<P>", "<S>", "<M>"])
def test_tags_are_seen_at_every_place(tag):
    """Also where a chunk ends inside the tag."""
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    ends = fim.chunk_ends(text.encode())
    assert len(ends) > 4
    cache: dict = {}
    seams = 0
    for at in range(0, 3_000):
        marked = (text[:at] + tag + text[at:]).encode()
        chunks = fim.Chunks(marked, cache)
        seams += any(at < e < at + 3 for e in chunks.ends)
        assert chunks.tagged()
        assert not fim.Chunks(marked.replace(b">", b"}"), cache).tagged()
    assert seams


def test_rows_and_exact_restoration(spark):
    rows = [(i, t) for i, t in enumerate(some_texts(60))] + [r[:2] for r in odd_rows()]
    docs = table(spark, rows)
    got = fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((r["doc_id"] or -1, r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"])
                  for r in got) == sorted((i or -1, n, form, a or 0, b or 0, out)
                                          for i, t in rows for n, form, a, b, out in [plain(i, t)])
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all((r["prefix_chars"] is None) == (r["form"] == "plain") for r in got)


def test_empty_table(spark):
    assert fim.transform(table(spark, []).limit(0)).collect() == []
