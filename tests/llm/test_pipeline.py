from __future__ import annotations

import os

import public_tokenizers
import pytest

import corpus_pipeline
from riskbook.llm import bpe, decontaminate, quality_rules, secrets, simhash
from riskbook.llm.common import documents

from .helpers import SF, odd_rows, table

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def test_stages_in_turn_on_whole_documents(spark):
    """Each stage on all its predecessor kept, against the operators' own results."""
    docs = documents(spark, SF)
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in after.collect()}
        if k == 0:
            want = {r["doc_id"] for r in quality_rules.score_rules(docs).collect() if r["kept"]}
        elif k == 1:
            want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif k == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            want = set(before) - {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
            texts = [r["text"] for r in bench.collect()]
            assert {i for i, t in before.items() if any(x in t for x in texts)} == set(before) - want
        else:
            want = set(before)
            found = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
            for i, t in rows.items():
                assert (t == before[i]) == (found[i]["n_live"] == 0)
        assert set(rows) == want and len(rows) < len(before) + (k == 3)
        if k != 3:
            assert all(rows[i] == before[i] for i in rows)
        docs = after
    last = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    path = public_tokenizers.path("word_bpe_49k.json")
    assert last == {r["doc_id"]: r["ids_sha256"] for r in bpe.encode(docs, path).collect()}


def test_odd_rows(spark):
    docs = table(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        got.collect()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
