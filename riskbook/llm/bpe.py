"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition are laid out as one linked
list of symbols.  An index maps every adjacent pair that has a merge rank to
all its positions; the active ranks are taken in ascending order, each
applied to all its positions at once, and only the lists of the pairs that
touch a merged place are updated.  Words that a task met before are not
encoded again (the memo is emptied when it holds ``MEMO_WORDS`` words, which
changes no result).

The vocabulary file is read on the driver, and broadcast: its size is fixed
by the vocabulary and does not follow the corpus.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, slices, texts

MEMO_WORDS = 400_000
SLICE = 8 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level
    vocabularies: printable Latin-1 stands for itself, the rest follow 0x100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


_SPACE = regex.compile(r"\s+")
_CONTROL_SPACE = regex.compile(r"[\x1c-\x1f]")


# Code points that the pattern tables of the tokenizers library
# do not know as letters or digits yet (ranges, hexadecimal), and capitals
# whose small letter is newer than the interpreter's tables.
_LATE = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
          0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {
          c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_HAS_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


def dated(pattern: str) -> str:
    """The pattern with those later letters and digits taken for symbols."""
    late = "".join("-".join(f"\\U{int(x, 16):08x}" for x in span.split("-")) for span in _LATE.split())
    return (pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]")
            .replace(r"[\p{L}]", rf"[\p{{L}}--[{late}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{late}]]"))


@dataclass
class WordBpe:
    """A word-end BPE vocabulary: NFC, lower case, white space dropped."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    special: dict[str, int] = field(default_factory=dict)
    suffix: str = "</w>"

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        return cls(model["vocab"], merges, pattern, special, model["end_of_word_suffix"])

    def __post_init__(self) -> None:
        self.base = max(self.vocab.values()) + 1
        self.rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in self.merges]
        keys = np.array([a * self.base + b for a, b, _ in self.rules], np.int64)
        self.key_rank = np.argsort(keys)
        self.keys = keys[self.key_rank]
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = regex.compile(dated(self.pattern), regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def chunks(self, text: str) -> list[str]:
        """White-space separated parts, in lower case: no pre-token spans two.
        Lower case is taken letter by letter (a final sigma is an ordinary
        one), and a special token is a part of its own."""
        if self.specials is not None and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _HAS_CAPITAL.search(text):
                text = text.translate(_SMALL)
            text = text.lower()
        if _CONTROL_SPACE.search(text):                 # str.split() takes these four for white space
            return _SPACE.sub(" ", text).strip(" ").split(" ") if _SPACE.sub("", text) else []
        return text.split()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and the number of
        tokens of each; by the pair occurrence index."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        n, ends = len(sym), np.cumsum(sizes)
        sym[ends - 1] = self.last[np.frombuffer(b"".join(raw), np.uint8)[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - sizes] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Put the pairs that begin at ``at`` into the index."""
            key = left * self.base + right
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            if not hit.any():
                return
            r, at = self.key_rank[found[hit]], at[hit]
            by = np.argsort(r, kind="stable")
            r, at = r[by], at[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if k not in places:
                    places[k] = []
                    heapq.heappush(active, k)
                places[k].append(part)

        at = np.flatnonzero(after >= 0)
        note(at, sym[at], sym[at + 1])
        while active:
            r = heapq.heappop(active)
            left, right, new = self.rules[r]
            lists = places.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            q = after[p]
            ok = (q >= 0) & (sym[p] == left) & (sym[q] == right)
            p, q = p[ok], q[ok]
            if left == right:                           # overlapping places: leftmost first
                taken, keep = -1, []
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x != taken:
                        keep.append(i)
                        taken = y
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            sym[p], sym[q] = new, -1
            far = after[q]
            after[p] = far
            has = far >= 0
            before[far[has]] = p[has]
            near = before[p]
            prior = near >= 0
            x, y = p[has], near[prior]
            note(np.r_[x, y], np.r_[sym[x], sym[y]], np.r_[sym[far[has]], sym[p[prior]]])
        left_over = sym >= 0
        return sym[left_over].astype("<u4"), np.add.reduceat(left_over, ends - sizes, dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by a space: the file names no decoder."""
        return " ".join([self.token[i] for i in ids])


class Memo:
    """Chunks already encoded in this task: packed ids, and decoded text."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.ids = {t: struct.pack("<I", i) for t, i in self.bpe.special.items()}
        self.text = {t: t for t in self.bpe.special}

    def add(self, chunks: set[str]) -> None:
        if len(self.ids) > MEMO_WORDS:
            self.clear()
        new = [c for c in chunks if c not in self.ids]
        words: list[str] = []
        sizes: list[int] = []
        for c in new:
            found = [c] if c.isalpha() else self.bpe.split.findall(c)
            words += found
            sizes.append(len(found))
        flat, counts = self.bpe.encode_words(words)
        ends = np.r_[0, np.cumsum(counts)][np.cumsum(sizes)].tolist() if new else []
        packed, names = flat.tobytes(), list(map(self.bpe.token.__getitem__, flat.tolist()))
        start = 0
        for c, end in zip(new, ends):
            self.ids[c] = packed[4 * start:4 * end]
            self.text[c] = names[start] if end == start + 1 else " ".join(names[start:end])
            start = end


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256``, with ``keep_ids`` also ``ids`` (array of int) and with
    ``keep_text`` also ``decoded``.

    NULL and empty texts have no tokens (the digests are those of nothing).
    Repeated rows give repeated results, a NULL ``doc_id`` stays NULL, an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(WordBpe.from_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(bpe := shared.value)
        for b in slices(batches, most=SLICE):
            parts = [bpe.chunks(t.decode()) for t in texts(b)]
            memo.add({c for cs in parts for c in cs})
            ids, decoded = memo.ids, memo.text
            rows: dict[str, list] = {k: [] for k in ("n", "ids", "sha", "text", "decoded")}
            for cs in parts:
                packed, text = b"".join([ids[c] for c in cs]), " ".join([decoded[c] for c in cs])
                rows["n"].append(len(packed) // 4)
                rows["sha"].append(sha256(packed).hexdigest())
                rows["decoded"].append(sha256(text.encode()).hexdigest())
                if keep_ids:
                    rows["ids"].append(packed)
                if keep_text:
                    rows["text"].append(text)
            cols = [b.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["sha"], pa.string()),
                    pa.array(rows["decoded"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                flat = np.frombuffer(b"".join(rows["ids"]), "<i4")
                cols.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(rows["n"])].astype(np.int32), flat))
                names.append("ids")
            if keep_text:
                cols.append(pa.array(rows["text"], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return id_text(docs).mapInArrow(run, schema)
