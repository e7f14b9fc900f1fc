"""Spans of long texts with very many matches."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskbook.llm import pii, secrets, spans

from .helpers import table

PATTERN = r"[0-9]+|é+x"


def brute(text, view):
    return [(m.start(), m.end(), "k", m[0], text[max(0, m.start() - view):m.start()]) for m in re.finditer(PATTERN, text)
            if m[0] != "7"]


@pytest.mark.parametrize("run", [1, 3, 512])
@pytest.mark.parametrize("view", [0, 4, 24])
def test_places_and_views_match_brute_force_at_any_run_length(spark, monkeypatch, run, view):
    monkeypatch.setattr(spans, "RUN", run)
    rng = random.Random(run + view)
    texts = ["".join(rng.choice(["7", "12", "é", "x", "😀", " ", "ab"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = spans.find(F.col("text"), PATTERN, "k", ok=lambda v: v != "7", view=view)
    for text, row in zip(texts, df.select(found.alias("f")).collect()):
        got = [(s["start"], s["end"], s["kind"], s["value"], s["before"] if view else "") for s in row["f"]]
        assert got == [(*b[:4], b[4] if view else "") for b in brute(text, view)]


@pytest.mark.parametrize("operator,unit,column", [
    (secrets.find_secrets, "token=%08x ", "n_assign"), (pii.find_personal_data, "%07x@b.cd ", "n_email")])
def test_texts_full_of_matches_end_in_seconds(spark, operator, unit, column):
    n = 2_000_000 // len(unit % 0)
    text = "".join(unit % (0x1234567 + k) for k in range(n))
    t = time.time()
    (row,) = operator(table(spark, [(1, text)])).select(column).collect()
    assert row[column] == n
    assert time.time() - t < 120
