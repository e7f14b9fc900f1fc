"""Source divergence audit with late string materialization.

Languages and sources get numbers.  One pass over the texts counts terms per
task and writes, as Parquet in the shared folder, a row per language and 64-bit
term digest (documents, and occurrences by source), and apart from these each
digest's string once.  Only digests and numbers are shuffled to add the counts
up and find the kept terms.  Then the smallest and largest string behind each
kept digest show whether two terms share it; the terms of such a digest are
told apart by a part number and counted anew from the texts.  A digest that is
not kept hides no kept term, as its documents are at least those of each of its
terms.  Strings are joined back to the terms that may be ranked.

Probabilities are whole numbers, p = 1 + floor(SCALE * (count + 2) / (N + 2V)),
and a divergence is floor((p - q)^2 / (p + q)); both are exact for languages of
up to 9 * 10^15 words.  Each task adds up the divergences of all source pairs
over its terms, and passes on the terms that are among its best, so a shuffle
carries a row per pair and task, and few terms.

Memory: a task holds about ``_TERMS`` terms and ``_PAIRS`` counts (then it
writes them and goes on, so more of them cost more rows only), one slice of
rows, one term's counts by source, and ``_CELLS`` pair sums.  Sources of a
language are gathered in one row, as every pair of them is a result.

Odd input: NULL text, lang and source count as ''.  Empty texts still make
their (lang, source) group occur.  Very long texts are counted in pieces cut
between terms.  Repeated rows are documents of their own.  Equal values rank
by the item's UTF-8 bytes.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import BROADCAST_MAX_BYTES, memory_bytes
from .common import slices, texts, written

SCALE_STEPS, SCALE_STEP = 3, 1000             # SCALE = 1000 ** 3, applied step by step to stay within 64 bits
_TERM = re.compile(rb"[a-z\x80-\xff]+")       # of bytes in lower case: letters a-z and all beyond ASCII
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 1 << 20
_TERMS, _PAIRS = 400_000, 2_000_000
_BATCH = 1 << 16
_CELLS, _TILE = 1 << 21, 512
_SMALL = 1 << 20      # digests that are broadcast at most
_COUNTS = pa.schema([("l", pa.int32()), ("digest", pa.int64()), ("term", pa.string()), ("docs", pa.int64()),
                     ("s", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_KEPT = pa.schema([("l", pa.int32()), ("digest", pa.int64()), ("part", pa.int32()), ("total", pa.int64()),
                   ("s", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_SCORES = pa.schema([("l", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("digest", pa.int64()),
                     ("part", pa.int32()), ("value", pa.int64())])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    text, at = text.lower(), 0                # bytes.lower() changes A-Z alone
    while len(text) - at > _PIECE:
        gap = _GAP.search(text, at + _PIECE)
        if gap is None:
            break
        yield _TERM.findall(text, at, gap.start())
        at = gap.start()
    yield _TERM.findall(text, at)


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple:
    """One entry per key, in order."""
    if not len(key):
        return (key, *counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[first], *(np.add.reduceat(c[order], first) for c in counts))


class _Counts:
    """Term counts of a task: terms and groups get numbers, and each (term,
    group) keeps its occurrences and documents in sorted arrays."""

    def __init__(self, bits: int) -> None:
        self.bits, self.groups = bits, {}
        self.clear()

    def clear(self) -> None:
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, langs: list[int], sources: list[int], raw: list[bytes]) -> None:
        number, ids, sizes = self.vocabulary.__getitem__, [], []
        for text in raw:
            before = len(ids)
            for found in _terms(text):
                ids.extend(map(number, found))
            sizes.append(len(ids) - before)
        groups = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        doc = np.repeat(np.arange(len(raw)), sizes)
        pairs, n = np.unique(doc << 32 | np.array(ids, np.int64), return_counts=True)
        self.parts.append(_summed((pairs & 0xFFFFFFFF) << 32 | groups[pairs >> 32], n, np.ones_like(n)))
        self.size += len(self.parts[-1][0])
        if self.size > _PAIRS:
            self.parts = [_summed(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > _PAIRS // 2 or len(self.vocabulary) > _TERMS

    def rows(self, named: bool) -> Iterator[pa.RecordBatch]:
        """The strings of all digests, and the counts."""
        if not self.size:
            return
        key, n, docs = _summed(*map(np.concatenate, zip(*self.parts)))
        lang, source = (np.array(x, np.int64) for x in zip(*self.groups))
        terms = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        digest = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(terms))
        if self.bits < 64:
            digest >>= np.uint64(64 - self.bits)
        digest = digest.view(np.int64)
        for a in range(0, len(terms), _BATCH):
            part = terms[a:a + _BATCH]
            yield _batch(_COUNTS, len(part), digest=digest[a:a + _BATCH], term=part)
        term, group = key >> 32, key & 0xFFFFFFFF
        order = np.lexsort((source[group], lang[group], term))
        term, group, n, docs = term[order], group[order], n[order], docs[order]
        row = term << 32 | lang[group]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        docs, ends = np.add.reduceat(docs, first), np.r_[first[1:], len(row)]
        for a in range(0, len(first), _BATCH):
            f, e = first[a:a + _BATCH], ends[a:a + _BATCH]
            entries, sizes = slice(f[0], e[-1]), e - f
            more = {"term": terms.take(pa.array(term[f]))} if named else {}
            yield _batch(_COUNTS, len(f), l=lang[group[f]], digest=digest[term[f]], docs=docs[a:a + _BATCH],
                         s=_lists(source[group[entries]], sizes, pa.int32()), n=_lists(n[entries], sizes, pa.int64()), **more)


def term_counts(docs: DataFrame, bits: int = 64, named: bool = False) -> DataFrame:
    """What each task counts in ``docs`` (``l, s, text``), in rows of two kinds:
    a digest's string (``digest, term``), and the counts of a digest in a
    language (``l, digest, docs`` and lists of ``s`` and ``n``, with the ``term``
    if ``named``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bits)
        for b in slices(batches):
            counts.add(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b))
            if counts.full():
                yield from counts.rows(named)
                counts.clear()
        yield from counts.rows(named)

    return docs.select("l", "s", "text").mapInArrow(
        run, "l int, digest long, term string, docs long, s array<int>, n array<long>")


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """Kept terms of each language: ``l, digest, part, total`` and the count in
    each source that has the term (lists ``s`` and ``n``).

    The rows of a term follow each other, so a batch is added up at once and
    its last term goes on with the next batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None               # the last term so far: l, digest, part, docs, size, s, n
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(4)
            now = [*(b.column(k).to_numpy() for k in range(4)), np.diff(lists.offsets.to_numpy()),
                   lists.flatten().to_numpy(), b.column(5).flatten().to_numpy()]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            done, held = _merged(now)
            yield _table(done, min_docs)
        if held is not None:
            yield _table(held, min_docs)

    return (counts.select("l", "digest", "part", "docs", "s", "n").repartition("l", "digest", "part")
            .sortWithinPartitions("l", "digest", "part")
            .mapInArrow(run, "l int, digest long, part int, total long, s array<int>, n array<long>"))


def _merged(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One row per term: all but the last, and the last."""
    lang, digest, part, docs, size, s, n = rows
    new = np.r_[True, (lang[1:] != lang[:-1]) | (digest[1:] != digest[:-1]) | (part[1:] != part[:-1])]
    term, first = np.cumsum(new) - 1, np.flatnonzero(new)
    base = int(s.max()) + 1
    key, n = _summed(np.repeat(term, size) * base + s, n)
    size = np.bincount(key // base, minlength=len(first))
    out = [lang[first], digest[first], part[first], np.add.reduceat(docs, first), size, key % base, n]
    last = len(key) - int(size[-1])
    return [*(x[:-1] for x in out[:5]), out[5][:last], n[:last]], [*(x[-1:] for x in out[:5]), out[5][last:], n[last:]]


def _table(rows: list[np.ndarray], min_docs: int) -> pa.RecordBatch:
    lang, digest, part, docs, size, s, n = rows
    kept = docs >= min_docs
    entries = np.repeat(kept, size)
    total = np.add.reduceat(n, np.cumsum(size) - size) if len(size) else size
    return _batch(_KEPT, int(kept.sum()), l=lang[kept], digest=digest[kept], part=part[kept], total=total[kept],
                  s=_lists(s[entries], size[kept], pa.int32()), n=_lists(n[entries], size[kept], pa.int64()))


def _told_apart(docs: DataFrame, counts: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (as ``_kept``) and their strings (``digest, part, term``)."""
    whole = counts.filter("l IS NOT NULL").drop("term").withColumn("part", F.lit(0))
    kept = written(_kept(whole, min_docs), "kept_terms")
    digests = kept.select("digest").distinct()
    strings = counts.filter("l IS NULL").select("digest", "term")
    ends = [F.min("term").alias("first"), F.max("term").alias("last")]
    if kept.count() <= _SMALL:        # strings of other terms are not shuffled at all
        words = strings.join(F.broadcast(digests), "digest", "left_semi").groupBy("digest").agg(*ends)
    else:
        words = strings.groupBy("digest").agg(*ends).join(digests, "digest", "left_semi")
    words = written(words, "term_strings")
    shared = words.filter("first != last").select("digest")
    if shared.isEmpty():
        return kept, words.select("digest", F.lit(0).alias("part"), F.col("first").alias("term"))
    order = Window.partitionBy("digest").orderBy("term")
    split = written(strings.join(shared, "digest", "left_semi").distinct()
                    .withColumn("part", F.row_number().over(order)), "split_terms")
    named = term_counts(docs, bits, named=True).filter("l IS NOT NULL").join(split, ["digest", "term"]).drop("term")
    apart = whole.join(shared, "digest", "left_anti").unionByName(named)
    names = (words.filter("first = last").select("digest", F.lit(0).alias("part"), F.col("first").alias("term"))
             .unionByName(split.select("digest", "part", "term")))
    return written(_kept(apart, min_docs), "kept_terms"), names


def probability(count: np.ndarray, size: np.ndarray, kept: np.ndarray) -> np.ndarray:
    whole = size + 2 * kept
    p, rest = np.divmod(count + 2, whole)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * SCALE_STEP, whole)
        p = p * SCALE_STEP + more
    return p + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


class _Scores:
    """Pair sums and best terms of a task."""

    def __init__(self, top: int) -> None:
        self.top, self.tiles, self.best = top, {}, {}

    def add(self, lang: int, p: np.ndarray, q: np.ndarray, has: np.ndarray, digest: np.ndarray,
            part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``p`` has a row per term and a column per source, ``q`` a row."""
        value = np.where(has & (p > q[:, None]), _f(p, q[:, None]), -1)
        best = self.best.get(lang, np.full((self.top, p.shape[1]), -1, np.int64))
        best = np.sort(np.concatenate([best, value]), axis=0)[-self.top:]
        self.best[lang] = best
        term, source = np.nonzero((value >= 0) & (value >= best[0]))         # ties with the last one too
        yield _batch(_SCORES, len(term), l=np.full(len(term), lang), i=source + 1, digest=digest[term],
                     part=part[term], value=value[term, source])
        for a in range(0, p.shape[1], _TILE):
            for b in range(a, p.shape[1], _TILE):
                left, right = p[:, a:a + _TILE], p[:, b:b + _TILE]
                tile = self.tiles.setdefault((lang, a, b), np.zeros((left.shape[1], right.shape[1]), np.int64))
                for i in range(left.shape[1]):
                    tile[i] += _f(left[:, i:i + 1], right).sum(0)
                if sum(t.size for t in self.tiles.values()) > _CELLS:
                    yield from self.pairs()

    def pairs(self) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), tile in self.tiles.items():
            i, j = np.indices(tile.shape).reshape(2, -1) + [[a + 1], [b + 1]]
            once = i < j
            yield _batch(_SCORES, int(once.sum()), l=np.full(int(once.sum()), lang), i=i[once], j=j[once],
                         value=tile.ravel()[once])
        self.tiles = {}


def scores(kept: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """What each task adds: sums of the divergence of the sources numbered ``i
    < j`` (``l, i, j, value``), and the terms that may be among the ``top`` of
    source ``i`` (``l, i, digest, part, value``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Scores(top)
        for b in batches:
            lang = b.column(0).to_numpy()
            for name in np.unique(lang).tolist():
                rows = b.take(pa.array(np.flatnonzero(lang == name)))
                sizes = rows.column(6)[0].values.to_numpy()
                kept_terms, whole = rows.column(7)[0].as_py(), rows.column(8)[0].as_py()
                step = max(1, _CELLS // len(sizes))
                for a in range(0, rows.num_rows, step):
                    r = rows.slice(a, step)
                    digest, part, total = (r.column(k).to_numpy() for k in (1, 2, 3))
                    length = np.diff(r.column(4).offsets.to_numpy())
                    n = np.zeros((r.num_rows, len(sizes)), np.int64)
                    n[np.repeat(np.arange(r.num_rows), length), r.column(4).flatten().to_numpy() - 1] = \
                        r.column(5).flatten().to_numpy()
                    yield from found.add(name, probability(n, sizes, kept_terms), probability(total, whole, kept_terms),
                                         n > 0, digest, part)
        yield from found.pairs()

    rows = kept.join(langs, "l").select("l", "digest", "part", "total", "s", "n", "sizes", "V", "whole")
    return rows.mapInArrow(run, "l int, i int, j int, digest long, part int, value long")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source's terms
    lie from every other source of its language (part ``pair``, all of them),
    and the ``top`` terms that set it apart from its language as a whole (part
    ``term``).  ``bits`` is the width of a term's digest.  See the module for
    odd input."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = written(plain.select("lang", "source").distinct().select(
        "lang", "source", F.dense_rank().over(Window.orderBy("lang")).alias("l"),
        F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("s")), "groups")
    few = memory_bytes(groups) <= BROADCAST_MAX_BYTES           # holds for the tables made of groups below

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    numbered = plain.join(small(groups), ["lang", "source"])
    counts = written(term_counts(numbered, bits), "term_counts")
    kept, words = _told_apart(numbered, counts, min_docs, bits)
    per_source = (kept.select("l", F.explode(F.arrays_zip("s", "n")).alias("e")).groupBy("l", "e.s")
                  .agg(F.sum("e.n").alias("size")))
    per_lang = kept.groupBy("l").agg(F.count("*").alias("V"), F.sum("total").alias("whole"))
    sized = groups.join(per_source, ["l", "s"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    langs = written(sized.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("s", "size"))).alias("all"))
                    .select("l", F.col("all.size").alias("sizes")).join(per_lang, "l"), "langs")
    found = written(scores(kept, small(langs), top), "scores")

    sums = found.filter("j IS NOT NULL").groupBy("l", "i", "j").agg(F.sum("value").alias("value"))
    other = groups.select("l", F.col("source").alias("item"), F.col("s").alias("o"))
    every = groups.join(small(other), "l").filter("s != o").select(
        "l", "lang", "source", "item", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = (every.join(sums, ["l", "i", "j"], "left")
             .withColumn("value", F.coalesce("value", F.lit(0)).cast("long")).withColumn("rank", F.row_number().over(order)))

    best = found.filter("j IS NULL").withColumnRenamed("i", "s").join(small(groups), ["l", "s"])
    terms = (best.join(words, ["digest", "part"]).withColumnRenamed("term", "item")
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    out = ["lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"]
    return pairs.select(*out).unionByName(terms.select(*out[:2], F.lit("term").alias("part"), *out[3:]))
