from __future__ import annotations

import random
import struct
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskbook.llm import bpe

from .helpers import SCHEMA, odd_rows, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(decoded.encode()).hexdigest())


def test_matches_the_library(spark, library):
    rng = random.Random(4)
    pool = "abcdeszSTRÉßéñÑİΣσς'’ \t\n\x0b\x1c\x1f\x85 　​_-!?.;#0123½²٣一二文̧́😀ﬁǅẞ\x00ก﻿ＡᲉ꟎"
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(800)]
    rows += [(900, "<|endoftext|>a<|startoftext|><|endoftext"), (901, "aaaaaaaaaaaaaaaa b'll'd's"), (902, None),
             (903, "HELLO World, hello world!! " * 50), (904, "zzz" * 3000), (905, "\x1c \x1d")]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in
           bpe.encode(table(spark, rows), PATH).collect()}
    assert got == {i: digests(library, t) for i, t in rows}


def test_ids_and_text(spark, library):
    r = bpe.encode(table(spark, [(1, "Some ordinary words, 42 of them.")]), PATH, keep_ids=True,
                   keep_text=True).first()
    assert r["ids"] == library.encode("Some ordinary words, 42 of them.", add_special_tokens=False).ids
    assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)


def test_memo_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    memo = bpe.Memo(b := bpe.WordBpe.from_file(PATH))
    for text in ("one two three four five", "six seven one two", "<|endoftext|> one"):
        parts = b.chunks(text)
        memo.add(set(parts))
        packed = b"".join(memo.ids[c] for c in parts)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(
            text, add_special_tokens=False).ids


def test_odd_rows(spark, library):
    got = bpe.encode(table(spark, odd_rows()), PATH).collect()
    assert len(got) == len(odd_rows())
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    long = next(t for i, t, *_ in odd_rows() if i == 4)
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] == 4} == {digests(library, long)}
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []
