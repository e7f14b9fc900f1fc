"""Language identification with error-correcting output codes.

Every language has a codeword; one binary character n-gram classifier
predicts each bit.  Decoding is loss-weighted: a bit's logistic loss counts
with that bit's reliability on rows left out of its training, and the
codeword of the smallest total loss wins.  A text whose two best codewords
are close is flagged as ambiguous.

Training uses a bounded sample of labelled rows (``per_language`` rows of
each language, chosen by a hash of ``doc_id``); the model, ``BUCKETS`` weights
for each bit, is broadcast.  Scoring is one pass over whole texts without a
shuffle; its memory follows ``SLICE``, not the row count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, slices, texts

BUCKETS = 4096
SLICE = 1 << 20
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
_PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of bytes of the texts' lower-case letters, where
    each text's begin, and their number (texts are framed by spaces, so none
    is empty, and what follows a text never matters)."""
    plain = [b"  " + t.decode().lower().encode().translate(_PLAIN) + b" " for t in raw]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    b = np.frombuffer(b"".join(plain) + b"  ", np.uint8).astype(np.uint32)
    two = (b[:-2] << np.uint32(8)) | b[1:-1]
    three = (two << np.uint32(8)) | b[2:]
    pair = np.empty((len(two), 2), np.uint32)
    pair[:, 0] = (two + np.uint32(1 << 24)) * np.uint32(0x9E3779B1) >> _SHIFT
    pair[:, 1] = three * np.uint32(0x85EBCA6B) >> _SHIFT
    return pair, np.r_[0, np.cumsum(sizes)[:-1]], sizes


def counts(raw: list[bytes]) -> np.ndarray:
    """Relative n-gram counts of each text, one row a text."""
    out = np.zeros((len(raw), BUCKETS), np.float32)
    for k, t in enumerate(raw):
        pair, _, _ = grams([t])
        out[k] = np.bincount(pair.ravel(), minlength=BUCKETS) / pair.size
    return out


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each of ``n`` classes.  Up to 7 classes the
    exhaustive code (every split of the classes); beyond, the best of some
    random dense codes by its smallest distance."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = np.array([[(c >> k) & 1 for c in range(1, 1 << (n - 1))] for k in range(n - 1)])
        return np.vstack([np.zeros((1, bits.shape[1]), int), bits]).astype(np.int8) * 2 - 1
    rng = np.random.default_rng(n)
    width = math.ceil(10 * math.log2(n))
    tries = [rng.choice([-1, 1], (n, width)).astype(np.int8) for _ in range(50)]

    def worst(m: np.ndarray) -> int:
        agree = m.astype(int) @ m.T
        return int((agree - 4 * width * np.eye(n, dtype=int)).max())

    return min(tries, key=worst)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray         # language x bit
    weights: np.ndarray      # bucket x bit
    bias: np.ndarray
    trust: np.ndarray        # weight of each bit in decoding
    close: float             # smallest difference of probabilities that is not ambiguous

    def margins(self, raw: list[bytes]) -> np.ndarray:
        pair, starts, sizes = grams(raw)
        got = self.weights[pair[:, 0]] + self.weights[pair[:, 1]]
        return np.add.reduceat(got, starts, axis=0) / (2 * sizes)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and ambiguity."""
        loss = np.logaddexp(0, -self.code[None] * margins[:, None, :]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second < self.close


def fit(x: np.ndarray, labels: list[str], steps: int = 200, l2: float = 1e-4, close: float = 0.2) -> Model:
    """Logistic classifiers of all bits at once, by gradient steps on
    columns scaled to their frequency; every fifth row is left out and
    measures the bits."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(lab) for lab in labels]].astype(np.float32)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4)
    x = x * scale
    test = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    xt, yt = x[~test], y[~test]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        slope = -yt / (1 + np.exp(np.clip(yt * (xt @ w + b), -30, 30))) / len(xt)
        for p, g, m, v in ((w, xt.T @ slope + l2 * w, mw, vw), (b, slope.sum(axis=0), mb, vb)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    seen, truth = (x[test], y[test]) if test.any() else (xt, yt)
    right = ((seen @ w + b) * truth > 0).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.05)
    return Model(languages, code, (w * scale[:, None]).astype(np.float32), b, trust / trust.sum() * code.shape[1],
                 close)


def train(docs: DataFrame, per_language: int = 600) -> Model | None:
    """A model from rows that are not held out and have a ``lang``; ``None``
    if there are none."""
    rows = (id_text(docs, "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                                         & F.col("doc_id").isNotNull())
            .withColumn("held", held_out(4, 2)).filter("not held"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(chance < share).limit(2 * per_language * len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = counts(texts(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())],
                ["doc_id", "lang", "x"])

    got = sorted(picked.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, x binary")
                 .collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    if not got:
        return None
    x = np.vstack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return fit(x, [r["lang"] for r in got])


def identify(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``,
    ``score`` (probability of the chosen codeword) and ``ambiguous``.

    NULL texts and texts without a letter are ``und`` with score 0 and
    ambiguous, as is everything if no row can be learned from.  A NULL
    ``doc_id`` is not held out and not learned from; repeated rows give
    repeated results; an empty table gives an empty result.  Rows of the
    sample are ordered by ``doc_id`` before fitting, so the model does not
    depend on the partitioning.  Other columns are not read.
    """
    model = train(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, most=SLICE):
            raw = texts(b)
            known = np.array([m is not None and _LETTER.search(t.decode()) is not None for t in raw])
            lang = np.full(len(raw), UNKNOWN, object)
            score, unsure = np.zeros(len(raw)), np.ones(len(raw), bool)
            at = np.flatnonzero(known)
            if len(at):
                best, p, close = m.decode(m.margins([raw[i] for i in at]))
                lang[at], score[at], unsure[at] = np.array(m.languages, object)[best], p, close
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lang.tolist(), pa.string()), pa.array(score),
                 pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = id_text(docs).withColumn("held_out", held_out(4, 2)).select("doc_id", "text", "held_out")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
