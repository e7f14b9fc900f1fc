"""Quality rules by suffix-array repetition.

The words of a text are suffix-sorted by prefix doubling: each round orders
the suffixes that still tie by the rank of what follows, and a suffix that
stands alone drops out.  Longest common prefixes of neighbours in that order
give the longest-common-prefix intervals, i.e. the maximal repeated
substrings.  Their spans are united, and the covered fraction and the
longest repeat are limited.

Everything happens within one text, so rows are scored where they are read:
no shuffle, and a task holds about ``SLICE`` bytes of text at a time (or one
longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, id_text, slices, texts

SLICE = 4 << 20
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules; fractions are of the text's words."""

    window: int = 5              # words of the shortest repeat that counts
    min_words: int = 10
    max_repeat_percent: int = 20     # of words in any repeat
    long_repeat: int = 20            # words of a repeat that counts as long
    max_long_percent: int = 15       # of words in long repeats
    longest: int = 100               # words: a longer repeat fails the text


def suffix_array(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of every text's words, and the ranks by the first 1, 2,
    4, ... words.  ``ids``: word codes from 0; ``doc``: the text of each
    word, ascending.  Suffixes of different texts never tie."""
    n = len(ids)
    end = np.searchsorted(doc, doc, side="right")       # where each word's text ends
    key = doc.astype(np.int64) * (int(ids.max(initial=0)) + 2) + ids + 1
    order = np.argsort(key)
    slots = np.arange(n)
    sorted_key = key[order]
    sa = order.copy()
    rank = np.empty(n + 1, np.int64)
    levels: list[np.ndarray] = []
    h = 1
    while True:
        head = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(sorted_key) else np.zeros(0, bool)
        first = slots[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] if len(head) else slots
        rank[order] = first
        levels.append(rank.copy())
        tied = ~(head & np.r_[head[1:], True]) if len(head) else head
        order, slots = order[tied], slots[tied]
        if not len(order):
            return sa, levels
        follow = np.minimum(order + h, n)
        after = np.where(order + h < end[order], rank[follow] + 1, 0)
        sorted_key = rank[order] * (n + 2) + after
        by = np.argsort(sorted_key)
        order, sorted_key = order[by], sorted_key[by]
        sa[slots] = order
        h *= 2


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray], doc: np.ndarray, least: int) -> np.ndarray:
    """Longest common prefix, in words, of each suffix and the next in the
    order; values below ``least`` may be given as 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    low = max(0, min(len(levels) - 1, least.bit_length() - 1))
    end = np.searchsorted(doc, doc, side="right")
    at = np.flatnonzero(levels[low][sa[:-1]] == levels[low][sa[1:]])
    a, b = sa[at], sa[at + 1]
    got = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, step = levels[k], 1 << k
        x, y = a + got, b + got
        inside = (x + step <= end[a]) & (y + step <= end[b])
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        got += same * step
    lcp[at] = got
    return lcp


def repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Per text: words in repeats, words in long repeats, the longest repeat,
    and the number of longest-common-prefix intervals."""
    n = len(ids)
    out = {k: np.zeros(n_docs, np.int64) for k in ("n_repeat_words", "n_long_words", "longest_repeat", "n_repeats")}
    if n < 2:
        return out
    sa, levels = suffix_array(ids, doc)
    lcp = neighbour_lcp(sa, levels, doc, rules.window)
    reach = np.zeros(n, np.int64)
    reach[sa] = np.maximum(lcp, np.r_[0, lcp[:-1]])
    for name, least in (("n_repeat_words", rules.window), ("n_long_words", rules.long_repeat)):
        at = np.flatnonzero(reach >= least)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + reach[at], 1)
        covered = np.cumsum(edge[:-1]) > 0
        out[name] = np.bincount(doc[covered], minlength=n_docs)
    np.maximum.at(out["longest_repeat"], doc, np.where(reach >= rules.window, reach, 0))
    high = lcp >= rules.window
    opens = np.flatnonzero(high & ~np.r_[False, high[:-1]])
    out["n_repeats"] = np.bincount(doc[sa[opens]], minlength=n_docs)
    return out


def statistics(raw: list[bytes], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The base counts and the repetition figures of some texts."""
    codes: dict[bytes, int] = {}
    words = [t.split() for t in raw]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(raw)), sizes)
    out = {"n_words": sizes}
    continuation = bytes(range(0x80, 0xC0))             # UTF-8 bytes that open no code point
    drop = WORD_SPACE + continuation
    out["word_chars"] = np.array([len(t.translate(None, drop)) for t in raw], np.int64)
    other = bytes(set(range(256)) - set(SYMBOLS))
    out["n_symbols"] = np.array([len(t.translate(None, other)) for t in raw], np.int64)
    dup = []
    for t in raw:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    return out | repeats(ids, doc, len(raw), rules)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_words", "longest_repeat",
          "n_repeats")


def score_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts of ``FIELDS``,
    ``base_failed`` and ``kept``.

    NULL and empty texts have no words: they fail the base (fewer than
    ``min_words``).  A NULL ``doc_id`` stays NULL, repeated rows give repeated
    results, an empty table an empty result; other columns are not read.
    Ties do not arise: a text's figures do not depend on other rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            got = statistics(texts(b), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[f], pa.int64()) for f in FIELDS]],
                                             ["doc_id", *FIELDS])

    counts = id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    verdict = (100 * F.col("n_long_words") <= rules.max_long_percent * F.col("n_words")) & (
        F.col("longest_repeat") <= rules.longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def keep(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns (NULL
    and empty texts fail; every repeated row is judged alike)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            g = statistics(texts(b), rules)
            n = g["n_words"]
            ok = ((n >= rules.min_words) & (100 * g["n_repeat_words"] <= rules.max_repeat_percent * n)
                  & (100 * g["n_long_words"] <= rules.max_long_percent * n) & (g["longest_repeat"] <= rules.longest))
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
