"""Fill-in-the-middle rewriting by content-defined chunk memoization.

A rolling hash over the last 32 bytes cuts a text into chunks, so a passage
that many documents share is cut alike in each.  What a cut needs to know of a
chunk (its code points, whether it holds a tag, its first and last bytes for a
tag across two chunks) is computed once and kept in a cache of the task, which
is looked up by the chunk's whole content.  A document's length is the sum of
its chunks' code points; their running sums name the chunk in which a cut
lies, and only that chunk is decoded to place the cut.

Chunks end at code points and hold ``_LEAST`` to ``_MOST`` bytes (a text's last
one may be shorter).  The cache starts anew when it holds ``_CACHE`` bytes, so
a task's memory is that, one slice of rows and its output.  Nothing is
shuffled.

Odd input: a NULL text counts as empty, and empty texts are plain.  A NULL
``doc_id`` counts as an empty id, so all such rows draw the same numbers.  Very
long texts are chunked like others.  Repeated rows give repeated results, an
empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_TAGS = [t.encode() for t in (PREFIX, SUFFIX, MIDDLE)]
_EDGE = max(map(len, _TAGS)) - 1           # bytes of a tag that may lie on one side of a chunk's end
_BITS, _LEAST, _MOST = 8, 32, 4096
_CACHE = 16 << 20
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


class Summary(NamedTuple):
    chars: int
    tagged: bool
    head: bytes
    tail: bytes


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of a text end."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return []
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):              # doubles the window: h covers 2k bytes after this round
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    starts = (raw & 0xC0) != 0x80           # a chunk may start where a code point does
    ends, last = [], 0
    for at in [*(np.flatnonzero((h[:-1] >> np.uint32(32 - _BITS) == 0) & starts[1:]) + 1).tolist(), len(raw)]:
        while at - last > _MOST:
            last += _MOST
            while not starts[last]:
                last -= 1
            ends.append(last)
        if at - last >= _LEAST or at == len(raw):
            ends.append(at)
            last = at
    return ends


def summarize(chunk: bytes) -> Summary:
    return Summary(len(chunk.decode()), b"<" in chunk and any(t in chunk for t in _TAGS), chunk[:_EDGE], chunk[-_EDGE:])


class Chunks:
    """The chunks of one text, their summaries taken from the task's cache."""

    def __init__(self, text: bytes, cache: dict[bytes, Summary]) -> None:
        self.text, self.ends = text, chunk_ends(text)
        self.parts: list[Summary] = []
        at = 0
        for end in self.ends:
            chunk = text[at:end]
            known = cache.get(chunk)         # found by hash, verified by content
            if known is None:
                known = cache[chunk] = summarize(chunk)
            self.parts.append(known)
            at = end
        self.upto = list(accumulate(p.chars for p in self.parts))
        self.chars = self.upto[-1] if self.upto else 0

    def tagged(self) -> bool:
        if any(p.tagged for p in self.parts):
            return True
        seams = (a.tail + b.head for a, b in zip(self.parts, self.parts[1:]) if b"<" in a.tail)
        return any(t in seam for seam in seams for t in _TAGS)

    def offset(self, chars: int) -> int:
        """The byte at which the first ``chars`` code points end."""
        k = bisect_right(self.upto, chars)
        if k == len(self.ends):
            return len(self.text)
        start, before = (self.ends[k - 1], self.upto[k - 1]) if k else (0, 0)
        chunk = self.text[start:self.ends[k]]
        if self.parts[k].chars == len(chunk):
            return start + chars - before
        return start + len(chunk.decode()[:chars - before].encode())


def _numbers(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def rewrite(doc_id: int | None, text: bytes, cache: dict[bytes, Summary], seed: int, rate: int, spm: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    chunks = Chunks(text, cache)
    n, (h1, h2, h3, h4) = chunks.chars, _numbers(doc_id, seed)
    if not text or h3 % 100 >= rate or chunks.tagged():
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = chunks.offset(first), chunks.offset(second)
    p, s, m = _TAGS
    if h4 % 100 < spm:
        return n, "spm", first, second - first, b"".join([s, text[b:], p, text[:a], m, text[a:b]])
    return n, "psm", first, second - first, b"".join([p, text[:a], s, text[b:], m, text[a:b]])


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n`` (code points), ``form`` (plain, psm
    or spm), ``prefix_chars``, ``middle_chars`` (NULL if plain) and ``output``.
    ``rate`` per cent of the texts are rewritten, ``spm`` per cent of those with
    the suffix first.  See the module for odd input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, Summary] = {}
        for b in slices(batches):
            if sum(map(len, cache)) > _CACHE:
                cache.clear()
            ids = b.column(0)
            n, form, prefix, middle, out = zip(*(rewrite(i, t, cache, seed, rate, spm)
                                                 for i, t in zip(ids.to_pylist(), texts(b))))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                         "output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  Rewritten texts hold no tag of
    their own, so the three tags are the only ones to split at."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (F.when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
            .when(form == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))).otherwise(output))
