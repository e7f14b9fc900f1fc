"""Benchmark decontamination: a BM25 inverted index of the test items,
searched by every training passage with block-max WAND.

Impacts are scaled so that an item scores 1 against itself; a passage that
reaches ``threshold`` is retrieved, and a retrieved item counts as leaked if
the passage also holds enough of its question and of its answer, word triple
by word triple.

The index is built by Spark from all items (document frequencies, lengths)
and broadcast in shards of at most ``SHARD_BYTES`` of item text, a bound that
the build checks; more items mean more shards, each searched in turn.
Documents are never shuffled: every text is read whole and cut into
overlapping passages of twice the longest item.  A text is searched only if it
holds, for some item, as many of the question's word triples as a leak needs
(``Gate``): that is exact, as a leak has them within one passage, and needs no
more than hashes of the words.  Of the texts that are left, block maxima are
summed for many passages together; a passage that reaches the threshold in no
block of items has no pivot and is skipped, the others are searched one by one.

Memory: one index shard, one slice of rows with a few arrays of its length, and
the words of the texts that pass the gate.  Very long texts are read like
others.  ``item_id`` is text, whatever its form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SHARD_BYTES = 4 << 20
BLOCK = 2
MEMO = 500_000
BOUND_CELLS = 2_000_000       # passages times blocks looked at together
SLICE = 4 << 20
PIECE = 1 << 20               # characters hashed together
_TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_GAP = regex.compile(r"[^\p{L}\p{M}\p{N}]")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@cache
def _word_signs() -> np.ndarray:
    """By code point: whether it belongs to a term."""
    signs = np.zeros(0x110000, bool)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    signs[[ord(c) for c in regex.findall(r"[\p{L}\p{M}\p{N}]", "".join(every))]] = True
    return signs


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]     # of _ROOT and its inverse mod 2**64, as far as needed
_ROOT = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, root in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            steps = np.full(n, root, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return [p[:n] for p in _POWERS]


def _pieces(lower: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The texts in lists of about ``PIECE`` characters, long ones cut between
    terms: (which text, its part)."""
    part: list[tuple[int, str]] = []
    room = PIECE
    for i, text in enumerate(lower):
        at = 0
        while len(text) - at > room:
            gap = _GAP.search(text, at + room)
            if gap is None:
                break
            yield [*part, (i, text[at:gap.start()])]
            part, room, at = [], PIECE, gap.start()
        part.append((i, text[at:]))
        room = max(1, room - (len(text) - at))
    yield part


def word_hashes(lower: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every term of the texts (in lower case), in order, and the
    text each is in: a polynomial in the code points, by running sums."""
    hashes, owners = [], []
    for part in _pieces(lower):
        signs = np.frombuffer("\n".join(t for _, t in part).encode("utf-32-le"), np.uint32)
        inside = np.r_[False, _word_signs()[signs], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(signs) + 1)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * power[:-1])]
        h = (sums[ends] - sums[starts]) * inverse[starts]
        hashes.append((h ^ h >> np.uint64(31)) * _MIX[0])
        first = np.cumsum([0, *(len(t) + 1 for _, t in part)])[:-1]
        owners.append(np.array([i for i, _ in part])[np.searchsorted(first, starts, "right") - 1])
    return np.concatenate(hashes), np.concatenate(owners)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` (at most 3) following words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ words[k:len(words) - n + 1 + k]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


class Gate:
    """Which texts hold enough of some item's question grams to leak it."""

    def __init__(self, words: list[str], questions: list[set[tuple]]) -> None:
        known, _ = word_hashes(words)
        self.total = np.array([len(q) for q in questions])
        pairs = [(len(g), g, i) for i, q in enumerate(questions) for g in q]
        self.by_size = {}
        for n in {p[0] for p in pairs}:
            grams = np.array([p[1] for p in pairs if p[0] == n])
            hashes = gram_hashes(known[grams.ravel()], n)[::n]          # of each gram's own words
            item = np.array([p[2] for p in pairs if p[0] == n])
            order = np.argsort(hashes, kind="stable")
            key, first = np.unique(hashes[order], return_index=True)
            seen = np.zeros(1 << 22, bool)
            seen[key >> np.uint64(42)] = True
            self.by_size[n] = key, np.r_[first, len(order)], item[order], seen

    def open(self, lower: list[str], question: float) -> list[bool]:
        """Per text: whether a leak is possible."""
        passed = np.zeros(len(lower), bool)
        words, text = word_hashes(lower)
        counts: list[np.ndarray] = []
        for n, (key, first, item, seen) in self.by_size.items():
            grams = gram_hashes(words, n)
            near = np.flatnonzero(seen[grams >> np.uint64(42)] & (text[:len(grams)] == text[n - 1:]))
            place = np.minimum(np.searchsorted(key, grams[near]), len(key) - 1)
            same = key[place] == grams[near]
            hit = np.unique(text[near[same]] * len(key) + place[same])      # distinct (text, gram)
            size = first[hit % len(key) + 1] - first[hit % len(key)]
            at = np.repeat(first[hit % len(key)] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            counts.append(np.repeat(hit // len(key), size) * len(self.total) + item[at])
        found, n = np.unique(np.concatenate(counts), return_counts=True) if counts else (np.zeros(0, int),) * 2
        enough = n >= question * self.total[found % len(self.total)] - 1e-6
        passed[found[enough] // len(self.total)] = True
        return passed.tolist()


@dataclass
class Index:
    """Posting lists over items 0..n-1 (ordered by their self score, so that
    impacts within a block are alike)."""

    ids: list                                   # item_id of each item
    words: dict[str, int]                       # term -> code, in order
    items: list[list[int]]                      # term codes of each item, in order
    posts: list[list[tuple[int, float]]]        # by term: (item, impact), ascending
    top: np.ndarray = field(init=False)         # by term: largest impact
    block_top: list[list[tuple[int, float]]] = field(init=False)   # by term: (last item, largest impact) of its blocks

    def __post_init__(self) -> None:
        self.top = np.array([max((w for _, w in p), default=0.0) for p in self.posts])
        self.block_top = []
        for p in self.posts:
            tops: dict[int, float] = {}
            for item, w in p:
                tops[item // BLOCK] = max(w, tops.get(item // BLOCK, 0.0))
            self.block_top.append([(k * BLOCK + BLOCK - 1, w) for k, w in tops.items()])
        self.n_blocks = -(-len(self.ids) // BLOCK)
        sizes = np.fromiter(map(len, self.block_top), np.int64, len(self.block_top))
        self.first = np.r_[0, np.cumsum(sizes)]             # by term: its part of the two arrays below
        flat = list(chain.from_iterable(self.block_top))
        self.block_of = np.array([last // BLOCK for last, _ in flat], np.int64)
        self.block_max = np.array([w for _, w in flat])
        self.span = max(map(len, self.items), default=1)
        self.parts = [self._grams(x) for x in self.items]
        self.gate = Gate(list(self.words), [question for question, _ in self.parts])

    def block_bounds(self, group: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Sum of block maxima, groups by blocks, for distinct (group, term) pairs."""
        sizes = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
        key = np.repeat(group, sizes) * self.n_blocks + self.block_of[at]
        return np.bincount(key, self.block_max[at], n * self.n_blocks).reshape(n, self.n_blocks)

    @staticmethod
    def grams(codes: list[int]) -> set[tuple]:
        n = min(3, len(codes))
        return {tuple(codes[i:i + n]) for i in range(len(codes) - n + 1)} if n else set()

    def _grams(self, codes: list[int]) -> tuple[set, set]:
        """Question: the first two thirds of an item; answer: the rest."""
        cut = (2 * len(codes) + 2) // 3
        return self.grams(codes[:cut]), self.grams(codes[cut:])

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of at least ``threshold`` for the distinct terms
        of a query, by block-max WAND."""
        cursors = [[self.posts[t], self.block_top[t], 0, 0, float(self.top[t])] for t in query if self.posts[t]]
        out = []
        cursors.sort(key=lambda c: c[0][c[2]][0])
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][2]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][2]][0] == item:
                pivot += 1
            bound, edge = 0.0, cursors[pivot + 1][0][cursors[pivot + 1][2]][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[:pivot + 1]:
                blocks = c[1]
                while c[3] < len(blocks) and blocks[c[3]][0] < item:
                    c[3] += 1
                if c[3] < len(blocks):
                    bound += blocks[c[3]][1]
                    edge = min(edge, blocks[c[3]][0] + 1)
            target = item + 1
            if bound < threshold - 1e-9:
                target = max(edge, item + 1)
            else:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    posts, at = c[0], c[2]
                    while at < len(posts) and posts[at][0] < item:
                        at += 1
                    if at < len(posts) and posts[at][0] == item:
                        score += posts[at][1]
                if score >= threshold - 1e-9:
                    out.append((item, score))
            for c in cursors[:pivot + 1]:
                while c[2] < len(c[0]) and c[0][c[2]][0] < target:
                    c[2] += 1
            cursors = [c for c in cursors if c[2] < len(c[0])]
            cursors.sort(key=lambda c: c[0][c[2]][0])
        return out


def indexes(benchmark: DataFrame, k1: float = 1.2, b: float = 0.75) -> Iterator[Index]:
    """Index shards over all items; idf and mean length are global."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([terms(t.decode()) for t in texts(batch)], pa.list_(pa.string()))],
                ["item_id", "words"])

    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .mapInArrow(split, "item_id string, words array<string>").filter(F.size("words") > 0)
             .groupBy("item_id", "words").agg(F.lit(1).alias("one")).drop("one")        # repeated rows: once
             .withColumn("size", F.size("words")))
    total = items.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.sum(
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 1)).alias("bytes")).first()
    if not total["n"]:
        return
    shards = -(-total["bytes"] // SHARD_BYTES)
    frequency = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count("*").alias("df"))
    shard = F.pmod(F.xxhash64("item_id", "words"), F.lit(shards))
    for s in range(shards):
        mine = items.filter(shard == s)
        idf = {r["word"]: np.log(1 + (total["n"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in frequency.join(
            mine.select(F.explode("words").alias("word")).distinct(), "word").collect()}
        rows = sorted((r["item_id"] is None, r["item_id"] or "", r["words"]) for r in mine.collect())
        scored = []
        for null, item, words in rows:
            impact = {}
            for w in words:
                tf = words.count(w)
                impact[w] = idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / total["mean"]))
            scored.append((sum(impact.values()), None if null else item, words, impact))
        scored.sort(key=lambda x: x[0])
        code = {w: i for i, w in enumerate(sorted(idf))}
        posts: list[list[tuple[int, float]]] = [[] for _ in code]
        for i, (whole, _, _, impact) in enumerate(scored):
            for w, x in impact.items():
                posts[code[w]].append((i, x / whole))
        yield Index([x[1] for x in scored], code, [[code[w] for w in x[2]] for x in scored], posts)


def _scan(index: Index, raw: list[bytes], memo: dict[str, tuple], threshold: float, question: float,
          answer: float) -> list[dict[int, tuple]]:
    """Per text: leaked items with score, overlaps and the passage's first word."""
    out: list[dict[int, tuple]] = [{} for _ in raw]
    lower = [t.decode().lower() for t in raw]
    if question > 0 and lower:
        chunks = [t.split() if go else [] for t, go in zip(lower, index.gate.open(lower, question))]
    else:
        chunks = [t.split() for t in lower]
    known, none = index.words, (-1,)
    if len(memo) > MEMO:
        memo.clear()
    for c in set(chain.from_iterable(chunks)).difference(memo):
        if c.isalpha():
            memo[c] = (known[c],) if c in known else none
        else:
            memo[c] = tuple(known.get(w, -1) for w in _TERM.findall(c))
    rows = [list(chain.from_iterable(map(memo.__getitem__, cs))) for cs in chunks]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if not sizes.sum():
        return out
    codes = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    span = index.span
    halves = np.maximum(1, -(-sizes // span))                       # each text's half passages
    first = np.r_[0, np.cumsum(halves)[:-1]]
    doc = np.repeat(np.arange(len(rows)), sizes)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    half = first[doc] + (np.arange(len(codes)) - start[doc]) // span
    hit = codes >= 0
    of = np.repeat(np.arange(len(rows)), halves)
    n_halves = len(of)
    last = np.arange(n_halves) == (first + halves - 1)[of]
    n_terms = len(index.top)
    pair = np.unique(half[hit] * n_terms + codes[hit])
    before = pair[~(np.arange(n_halves) == first[of])[pair // n_terms]] - n_terms     # also in the passage before
    pair = np.union1d(pair, before)                                 # distinct (passage, term)
    passage_of = pair // n_terms
    reach = np.zeros(n_halves)                                      # best block bound of each passage
    step = max(1, BOUND_CELLS // index.n_blocks)
    for h in range(0, n_halves, step):
        to = min(h + step, n_halves)
        lo, hi = np.searchsorted(passage_of, (h, to))
        reach[h:to] = index.block_bounds(passage_of[lo:hi] - h, pair[lo:hi] % n_terms, to - h).max(axis=1)
    for h in np.flatnonzero(reach >= threshold - 1e-9).tolist():
        d = int(of[h])
        if last[h] and h > first[d]:
            continue                                                # lies within the passage before
        at = (h - int(first[d])) * span
        passage = rows[d][at:at + 2 * span]
        found = index.search(sorted({c for c in passage if c >= 0}), threshold)
        if not found:
            continue
        grams = {n: {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)} for n in (1, 2, 3)}
        for item, score in found:
            shares = []
            for part in index.parts[item]:
                n = len(next(iter(part))) if part else 0
                shares.append(len(part & grams[n]) / len(part) if part else 1.0)
            if shares[0] >= question and shares[1] >= answer and score > out[d].get(item, (0.0,))[0] + 1e-9:   # ties: the first
                out[d][item] = (min(1.0, score), *shares, at)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6,
               answer: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """One row for every leaked item of every row of ``docs``: ``doc_id``,
    ``item_id``, ``score``, ``question_overlap``, ``answer_overlap`` and
    ``first_word`` of the best passage.

    NULL and empty texts hold no item; items without a word are never found;
    items that repeat a text under other ids are all reported, a repeated item
    row once.  Repeated documents give repeated results, NULL ids stay NULL,
    an empty table on either side gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    schema = ("doc_id long, item_id string, score double, question_overlap double, answer_overlap double, "
              "first_word long")
    kinds = [pa.int64(), pa.string(), *[pa.float64()] * 3, pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, memo = shared.value, {}
            for batch in slices(batches, most=SLICE):
                leaks = _scan(index, texts(batch), memo, threshold, question, answer)
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.ids[i], *got) for d, of in enumerate(leaks) for i, got in sorted(of.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kinds[k]) for k, c in enumerate(zip(*rows))],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that hold no leaked item, with all their columns
    (NULL and empty texts hold none; every repeated row is judged alike; an
    empty benchmark keeps everything)."""
    clean = docs
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo: dict[str, tuple] = {}
            for batch in slices(batches, most=SLICE):
                leaks = _scan(shared.value, texts(batch), memo, limits.get("threshold", 0.6),
                              limits.get("question", 0.6), limits.get("answer", 0.5))
                yield batch.filter(pa.array([not x for x in leaks], pa.bool_()))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
