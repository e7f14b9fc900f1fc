"""Exact repeats by a depth-limited radix sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere
else too.  Suffixes are ordered by ``length`` bytes at most, most significant
digit first; a suffix that stands alone after a pass is unique and drops out,
and suffixes that are equal after the last pass are the repeated windows.

The digits are chosen by content, so that few rows move:

1. The first digit of a suffix is the smallest hashed ``gram`` among those in
   its ``length`` bytes (leftmost on ties), with its place: equal windows have
   the same one at the same place.  Neighbouring suffixes share it, so a run of
   about ninety suffixes is one row (*stretch*).  A gram that no other stretch
   has ends all suffixes of the run at once.
2. The second digit is the hash of all bytes of the stretch: stretches that
   are equal as a whole are repeated as a whole (copies end here).  Where a
   text repeats one period, its equal stretches follow each other and are one
   row, so a long run of one byte is a few rows.
3. Different stretches under one gram are dealt by the gram with their bytes,
   and their windows are compared within the task.  A gram with more than
   ``GROUP`` different stretches is dealt by its windows' hashes instead,
   counted before the shuffle, so no task gathers such a group.

Texts are shuffled once (by row): the join that cuts out the stretches
to compare and the one that removes repeats share the exchange.  Nothing is
collected.  Rows are written once with an id of their own (``did``), as a
``doc_id`` may be NULL or repeat.  Digits are 64-bit hashes (gram and content
together 128 bits), so equality is exact up to hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import HotKeys, salted_join
from ..session import shuffle_partitions
from .common import slices, texts, written

GROUP = 4096
GRAM = 24
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64."""

    def __init__(self) -> None:
        self.grow(SLICE)

    def grow(self, n: int) -> None:
        up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def prefix(self, b: np.ndarray) -> np.ndarray:
        """Running hashes: those of any substring follow from two of them."""
        if len(b) >= len(self.up):
            self.grow(2 * len(b))
        out = np.zeros(len(b) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((b.astype(_U) + _U(1)) * self.up[:len(b)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (prefix[end] - prefix[start]) * self.down[start]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stretches(raw: list[bytes], length: int, powers: _Powers) -> dict[str, np.ndarray]:
    """Runs of suffixes of some texts that share their first digit: ``doc``,
    ``lo`` and ``hi`` (first and last suffix, in the text), ``at`` (place of
    the gram), ``gram`` and ``body`` (the two digits), ``times``.  Where a text
    repeats one period, equal stretches follow each other; they are one entry,
    with the first ``lo``, the last ``hi`` and their number as ``times``."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    none = np.zeros(0, np.int64)
    out = dict.fromkeys(("doc", "lo", "hi", "at", "times"), none) | dict.fromkeys(("gram", "body"), none.astype(_U))
    n = int(sizes.sum())
    if n < length:
        return out
    k = min(GRAM, length)
    w = length - k + 1
    prefix = powers.prefix(np.frombuffer(b"".join(raw), np.uint8))
    places = np.arange(n - k + 1)
    gram = _mix(powers.between(prefix, places, places + k))
    bits = _U(max(20, n.bit_length()))
    ranked = (gram >> bits << bits) | places.astype(_U)
    padded = np.r_[ranked, np.full(-len(ranked) % w, ~_U(0))].reshape(-1, w)
    from_left = np.minimum.accumulate(padded, axis=1).ravel()
    from_right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n_windows = n - length + 1
    least = np.minimum(from_right[:n_windows], from_left[w - 1:w - 1 + n_windows])
    anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    doc = np.repeat(np.arange(len(raw)), sizes)[:n_windows]
    i = np.flatnonzero(np.arange(n_windows) + length <= (starts + sizes)[doc])
    if not len(i):
        return out
    a, d = anchor[i], doc[i]
    opens = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    lo, hi, at, d = i[opens], i[np.r_[opens[1:] - 1, len(i) - 1]], a[opens], d[opens]
    with np.errstate(over="ignore"):
        body = _mix(powers.between(prefix, lo, hi + length) + _U(0xD6E8FEB86659FD93) * (at - lo).astype(_U)
                    + _U(0xA0761D6478BD642F) * (hi - lo).astype(_U))
    digit = gram[at]
    again = (digit[1:] == digit[:-1]) & (body[1:] == body[:-1]) & (d[1:] == d[:-1]) & (lo[1:] == hi[:-1] + 1)
    first = np.flatnonzero(np.r_[True, ~again])
    last = np.r_[first[1:], len(d)] - 1
    d, lo, hi, at = d[first], lo[first], hi[last], at[first]
    return {"doc": d, "lo": lo - starts[d], "hi": hi - starts[d], "at": at - starts[d], "gram": digit[first],
            "body": body[first], "times": last - first + 1}


def _stretch_rows(rows: DataFrame, length: int, placed: bool) -> DataFrame:
    """Stretches of all texts: the digits and the row's id; ``placed``: with
    the places, else with ``times``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in slices(batches, most=SLICE):
            s = stretches(texts(b), length, powers)
            cols = [pa.array(s["gram"].view(np.int64)), pa.array(s["body"].view(np.int64)),
                    pa.array(b.column(0).to_numpy()[s["doc"]])]
            names = ["gram", "body", "did"]
            more = ["lo", "hi"] if placed else ["times"]
            cols += [pa.array(s[c].astype(np.int32)) for c in more]
            names += more
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.select("did", "text").mapInArrow(
        run, "gram long, body long, did long" + (", lo int, hi int" if placed else ", times int"))


def _windows(pieces: list[bytes], length: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of some pieces, and the piece of each."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    prefix = powers.prefix(np.frombuffer(b"".join(pieces), np.uint8))
    counts = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    start = np.arange(int(counts.sum())) - first[piece] + np.r_[0, np.cumsum(sizes)[:-1]][piece]
    return _mix(powers.between(prefix, start, start + length)), piece


def _compare(pieces: DataFrame, length: int) -> DataFrame:
    """Within each gram of a partition (sorted by it): the windows of single
    stretches that another stretch of the gram has too."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        data = [x or b"" for x in rows.column("bytes").to_pylist()]
        h, piece = _windows(data, length, _Powers())
        key = _mix(rows.column("gram").to_numpy().view(_U)[piece] ^ h) ^ h
        _, code, n = np.unique(key, return_inverse=True, return_counts=True)
        single = rows.column("single").to_numpy(zero_copy_only=False)
        sizes = np.bincount(piece, minlength=len(data))
        offset = np.arange(len(h)) - np.r_[0, np.cumsum(sizes)[:-1]][piece]
        hit = np.flatnonzero((n[code] > 1) & single[piece])
        start = rows.column("lo").to_numpy()[piece[hit]] + offset[hit]
        new = np.flatnonzero(np.r_[True, (np.diff(piece[hit]) != 0) | (np.diff(start) != 1)]) if len(hit) else hit
        last = np.r_[new[1:] - 1, len(hit) - 1] if len(hit) else hit
        of = piece[hit[new]]
        return pa.RecordBatch.from_arrays(
            [rows.column("did").combine_chunks().take(pa.array(of)),
             pa.array(start[new].astype(np.int32)), pa.array((start[last] + length).astype(np.int32))],
            ["did", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in slices(batches, "bytes", SLICE):
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            grams = held.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))            # the last gram may go on
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return pieces.mapInArrow(run, "did long, a int, b int")


def _compare_large(pieces: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many stretches, dealt by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in slices(batches, "bytes", SLICE // 4):
            t = pa.Table.from_batches([b])
            h, piece = _windows(t.column("bytes").to_pylist(), length, powers)
            sizes = np.bincount(piece, minlength=t.num_rows)
            start = np.arange(len(h)) - np.r_[0, np.cumsum(sizes)[:-1]][piece] + t.column("lo").to_numpy()[piece]
            take = pa.array(piece)
            yield pa.RecordBatch.from_arrays(
                [t.column(c).combine_chunks().take(take) for c in ("gram", "did", "single")]
                + [pa.array(start.astype(np.int32)), pa.array(h.view(np.int64))],
                ["gram", "did", "single", "a", "h"])

    windows = pieces.mapInArrow(run, "gram long, did long, single boolean, a int, h long")
    again = windows.groupBy("gram", "h").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "h")
    return (windows.filter("single").join(again, ["gram", "h"])
            .select("did", "a", (F.col("a") + length).alias("b")))


def _join_digits(placed: DataFrame, marked: DataFrame, equal: DataFrame) -> DataFrame:
    """Stretches with their marks, by both digits.  Stretches that hold more
    than an even share of the rows (a passage in a third of all texts) are
    spread over tasks by a salt."""
    total = equal.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = max(1, total // shuffle_partitions(placed.sparkSession))
    key = F.struct("gram", "body").alias("digits")
    hot = written(equal.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_fan")),
                  "hot_stretches")
    n = hot.count()
    if not n:
        return placed.join(marked, ["gram", "body"])
    marked = marked.withColumnRenamed("gram", "g").withColumnRenamed("body", "b")
    return salted_join(placed.withColumn("digits", F.struct("gram", "body")),
                       marked.withColumn("digits", F.struct(F.col("g").alias("gram"), F.col("b").alias("body"))),
                       "digits", HotKeys(hot, n)).drop("g", "b", "digits")


def remove_repeats(docs: DataFrame, length: int = 200, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and, with ``keep_text``, ``kept`` (binary).

    NULL and empty texts, and texts under ``length`` bytes, lose nothing.  A
    repeated row repeats its text, and each loses it.  Rows with a NULL
    ``doc_id`` are treated like any other and keep the NULL; an empty table
    gives an empty result; other columns are not read.
    """
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("did"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text")), "repeat_texts")
    rows = rows.withColumn("did", F.coalesce("did", F.lit(-1)))       # never NULL: no filter for it parts the shared shuffle
    equal = written(_stretch_rows(rows, length, False).groupBy("gram", "body").agg(
        F.sum("times").alias("n"), F.min("did").alias("holder")), "stretches")
    several = equal.groupBy("gram").agg(F.count("*").alias("bodies"), F.sum("n").alias("all")).filter("all > 1")
    marked = equal.join(several, "gram").select(
        "gram", "body", (F.col("n") > 1).alias("whole"), "holder",
        (F.col("bodies") > 1).alias("mixed"), (F.col("bodies") > GROUP).alias("large"))
    placed = _join_digits(_stretch_rows(rows, length, True), marked, equal).select(
        "did", F.struct("gram", "lo", "hi", "whole", (F.col("mixed") & (~F.col("whole") | (
            F.col("did") == F.col("holder")))).alias("compare"), "large").alias("s"))
    found = written(placed.groupBy("did").agg(F.collect_set("s").alias("s")), "repeats")    # one text's stretches
    asked = found.select("did", F.filter("s", lambda s: s["compare"]).alias("s")).filter(F.size("s") > 0)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            out: list[tuple] = []
            for did, raw, ss in zip(b.column(1).to_pylist(), texts(b), b.column(3).to_pylist()):
                out += [(s["gram"], did, s["lo"], not s["whole"], s["large"], raw[s["lo"]:s["hi"] + length])
                        for s in ss]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["gram", "did", "lo", "single", "large", "bytes"])

    dealt = rows.select("doc_id", "did", "text")
    # With all columns of ``dealt``: then this join and the last one share the shuffle of the texts.
    pieces = dealt.join(asked, "did").select("doc_id", "did", "text", "s").mapInArrow(
        extract, "gram long, did long, lo int, single boolean, large boolean, bytes binary")
    small = pieces.filter("not large").drop("large").repartition("gram").sortWithinPartitions("gram")
    spans = _compare(small, length).unionByName(_compare_large(pieces.filter("large").drop("large"), length))
    parts = spans.groupBy("did").agg(F.collect_set(F.struct("a", "b")).alias("parts"))
    whole = found.select("did", F.transform(F.filter("s", lambda s: s["whole"]), lambda s: F.struct(
        s["lo"].alias("a"), (s["hi"] + length).alias("b"))).alias("whole"))
    cuts = whole.join(parts, "did", "left").select("did", F.concat("whole", F.coalesce(
        "parts", F.expr("cast(array() as array<struct<a:int,b:int>>)"))).alias("cuts")).filter(F.size("cuts") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            out: dict[str, list] = {k: [] for k in ("n", "removed", "spans", "sha", "kept")}
            for raw, cs in zip(texts(b), b.column(2).to_pylist()):
                kept, at, removed, n = [], 0, 0, 0
                for c in sorted((c["a"], c["b"]) for c in cs or ()):
                    if c[0] > at or not n:
                        kept.append(raw[at:c[0]])
                        n, removed, at = n + 1, removed + c[1] - c[0], c[1]
                    elif c[1] > at:
                        removed, at = removed + c[1] - at, c[1]
                kept.append(raw[at:])
                rest = b"".join(kept)
                out["n"].append(len(raw))
                out["removed"].append(removed)
                out["spans"].append(n)
                out["sha"].append(sha256(rest).hexdigest())
                if keep_text:
                    out["kept"].append(rest)
            cols = [b.column(0), *[pa.array(out[k], pa.int64()) for k in ("n", "removed", "spans")],
                    pa.array(out["sha"], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out["kept"], pa.binary())] if keep_text else []),
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                                             + ["kept"] * keep_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.join(cuts, "did", "left").select("doc_id", "text", "cuts").mapInArrow(
        cut, schema + (", kept binary" if keep_text else ""))
