"""Toxicity after noisy-channel deobfuscation.

Disguised words - digits and signs for letters, letters set apart, letters
doubled or drawn out, words cut in two - are lattices of the characters they
may stand for.  In a run of single letters, and between two parts of a word,
each space is kept (a word edge) or dropped.  A character trigram model, counted
over the whole corpus, scores the paths; Viterbi decoding restores the likeliest
spelling, and the restored text is scored.

Every token with signs for letters and every run of single letters is decoded.
Scoring decodes doubled letters and words cut in two only where the joined or
shortened word carries a weight: other results of the decoder would not change
the score (``Restorer.text`` decodes them all).

The model of the corpus is a table of ``CLASSES ** 3`` counts, summed from
every text.  The classifier is a logistic model over words and word
beginnings, learned from about ``train_rows`` labelled ids and at most
``TEXTS`` different texts of each; its features are words of those texts.  Both
are broadcast with these bounds, whatever the corpus.  Scoring is one pass over
whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, id_text, slices, texts, written
from .quality_model import label_sample

CLASSES = 28                     # word edge, a to z, any other letter
TEXTS = 4                        # different texts learned from under one id
MEMO = 500_000
SLICE = 4 << 20

# Letters that a sign or digit is used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
BREAKS = ".-_*·"                 # signs set between the letters of a word
MINUS_LOG = {"plain": 0.0, "leet": 1.2, "drop": 1.0, "repeat": 0.7}
APART, CUT = (1.0, 0.0), (0.0, 1.5)     # of a space kept and dropped: between single letters, between parts of a word
_SIGNS = regex.escape("".join(LEET))
_EDGE = "\"'`,;:?!.()[]{}<>«»…*#%&|+-_="
_NOISY = regex.compile(rf"\p{{L}}[{_SIGNS}{regex.escape(BREAKS)}]+\p{{L}}|[{_SIGNS}]{{1,2}}\p{{L}}|\p{{L}}[{_SIGNS}]|(\p{{L}})\1\1")
_DOUBLE = regex.compile(r"(\p{L})\1")
_LETTER = rf"[\p{{L}}{_SIGNS}]"
_APART = regex.compile(rf"(?<![\p{{L}}\p{{N}}]){_LETTER}(?:[ .\-_*·]{_LETTER}){{2,}}(?![\p{{L}}\p{{N}}])")
_WORD = regex.compile(r"\p{L}+")


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[ord("a"):ord("z") + 1] = np.arange(1, 27)
    t[ord("A"):ord("Z") + 1] = np.arange(1, 27)
    t[0xC0:] = 27                # first byte of any other character; the rest are skipped
    return t


_CLASS = _class_table()
_TAIL = bytes(range(0x80, 0xC0))


def trigram_counts(raw: list[bytes]) -> np.ndarray:
    """Counts of character-class triples; texts are framed by word edges."""
    b = _CLASS[np.frombuffer((b"  " + b"  ".join(raw) + b"  ").translate(None, _TAIL), np.uint8)]
    code = (b[:-2] * CLASSES + b[1:-1]) * CLASSES + b[2:]
    return np.bincount(code, minlength=CLASSES ** 3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Minus log of P(character | the two before it), from all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for b in slices(batches):
            total += trigram_counts(texts(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    got = id_text(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full(CLASSES ** 3, 0.1)
    for r in got:
        counts[r["code"]] += r["n"]
    counts = counts.reshape(-1, CLASSES)
    return -np.log(counts / counts.sum(axis=1, keepdims=True)).ravel()


def lattice(token: str, space: tuple[float, float] | None = None) -> list[list[tuple[str, float]]]:
    """For each place of a token the letters it may stand for ('': none)
    and what the channel asks for each.  With ``space`` (its costs kept and
    dropped) the breaks in a token are word edges or nothing."""
    out: list[list[tuple[str, float]]] = []
    run = 0
    for i, c in enumerate(token):
        run = run + 1 if i and c == token[i - 1] else 1
        if space and c in " .-_*·":
            out.append([(" ", space[0]), ("", space[1])])
        elif c.isalpha():
            cost = MINUS_LOG["plain"]
            out.append([(c, cost), ("", MINUS_LOG["repeat"])] if run > 1 else [(c, cost)])
        elif c in LEET:
            out.append([(x, MINUS_LOG["leet"]) for x in LEET[c]]
                       + [("", MINUS_LOG["drop"] if run > 1 else MINUS_LOG["drop"] + 2)])
        else:
            out.append([("", MINUS_LOG["drop"])])
    return out


def viterbi(token: str, cost: np.ndarray | list[float], space: tuple[float, float] | None = None) -> str:
    """The likeliest letters behind a token: states are the last two
    classes, so at most ``CLASSES ** 2`` live at a place (few do)."""
    def code(c: str) -> int:
        k = ord(c) - 96
        return 0 if c == " " else k if 1 <= k <= 26 else 27

    paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for place in lattice(token, space):
        after: dict[int, tuple[float, tuple]] = {}
        for state, (spent, path) in paths.items():
            for c, channel in place:
                if c:
                    k = code(c)
                    total, to, way = spent + channel + cost[state * CLASSES + k], state % CLASSES * CLASSES + k, (path, c)
                else:
                    total, to, way = spent + channel, state, path
                if to not in after or total < after[to][0]:
                    after[to] = (total, way)
        paths = after
    best = min(paths, key=lambda s: paths[s][0] + cost[s * CLASSES])
    letters, path = [], paths[best][1]
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters))


class Restorer:
    """Restored spelling of tokens, remembered within a task."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.tolist()
        self.known: dict[tuple, str] = {}

    def decode(self, token: str, space: tuple[float, float] | None = None) -> str:
        if (token, space) not in self.known:
            if len(self.known) > MEMO:
                self.known.clear()
            self.known[token, space] = viterbi(token, self.cost, space)
        return self.known[token, space]

    def token(self, token: str, doubles: bool = False) -> str:
        """A token with its core restored; signs around it stay, but for one
        or two at its end that often stand for letters.  With ``doubles`` also
        a core whose only disguise may be a doubled letter."""
        core = token.strip(_EDGE)
        if not core or not (_NOISY.search(core) or doubles and _DOUBLE.search(core)):
            return token
        at = token.find(core)
        return token[:at] + self.decode(core) + token[at + len(core):]

    def apart(self, text: str) -> list[tuple[str, str]]:
        """Runs of single letters (signs among them, if letters are not fewer)
        and what they stand for."""
        return [(m[0], self.decode(m[0], APART)) for m in _APART.finditer(text)
                if 2 * sum(map(str.isalpha, m[0])) > len(m[0]) // 2]

    def joined(self, first: str, second: str) -> str:
        """Two tokens as one word, if that is likelier than two."""
        return self.decode(f"{first} {second}", CUT)

    def text(self, text: str) -> str:
        """A lower-case text with its disguised words restored."""
        for run, word in self.apart(text):
            text = text.replace(run, word, 1)
        tokens, out = [self.token(t, doubles=True) for t in text.split()], []
        for t in tokens:
            word = self.joined(out[-1], t) if out and _part(out[-1], t) else " "
            if " " in word:
                out.append(t)
            else:
                out[-1] = word
        return " ".join(out)


def _part(first: str, second: str) -> bool:
    """Whether two tokens may be a word that was cut in two: letters alone,
    and the first no longer than three."""
    return len(first) <= 3 and first.isalpha() and second.isalpha() and 4 <= len(first) + len(second) <= 20


_TWICE = re.compile(r"([^\W\d_])\1")
_AGAIN = re.compile(r"(.)\1+", re.S)
_BREAK = frozenset(["", *BREAKS])


def _single(word: str) -> str:
    """A word with every doubled letter written once."""
    return _AGAIN.sub(r"\1", word)


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters."""
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k)]


def features(text: str, restorer: Restorer, memo: dict[str, tuple[str, ...]]) -> set[str]:
    """All features of a text's restored words (each once)."""
    found: set[str] = set()
    text = text.lower()
    for _, words in restorer.apart(text):
        found.update(f for w in words.split() for f in word_features(w))
    for c in set(text.split()):
        got = memo.get(c)
        if got is None:
            if len(memo) > MEMO:
                memo.clear()
            words = chain(_WORD.findall(restorer.token(c)), _WORD.findall(c))
            memo[c] = got = tuple(dict.fromkeys(f for w in words for f in word_features(w)))
        found.update(got)
    return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Scorer:
    """Scores texts by the weights of their restored words; what a token adds
    is remembered within a task."""

    def __init__(self, model: Model, cost: np.ndarray) -> None:
        self.model, self.restorer = model, Restorer(cost)
        self.memo: dict[str, tuple[str, ...]] = {}
        self.single = {_single(f.rstrip("-")) for f in model.weights}

    def weighed(self, words: list[str]) -> set[str]:
        return {f for w in words for f in word_features(w) if f in self.model.weights}

    def of_token(self, token: str) -> tuple[str, ...]:
        core = token.strip(_EDGE)
        if core.isalpha() and not _TWICE.search(core):       # most tokens: nothing to decode
            weights = self.model.weights
            return tuple([f for f in (core, core[:4] + "-", core[:5] + "-", core[:6] + "-")
                          if f in weights and (f == core or len(core) >= len(f) - 1)])
        found = self.weighed(_WORD.findall(token))
        restored = self.restorer.token(token)
        if restored != token:
            found |= self.weighed(_WORD.findall(restored))
        elif _TWICE.search(token) and self.may_double(token):
            found |= self.weighed(_WORD.findall(self.restorer.token(token, doubles=True)))
        if token[1:2] in _BREAK and len(token) > 4:
            for _, words in self.restorer.apart(token):
                found |= self.weighed(words.split())
        return tuple(found)

    def may_double(self, token: str) -> bool:
        """Whether some spelling of a token with fewer doubled letters may
        have a weighed feature: then that and the token's start are the same
        with every doubled letter written once."""
        for word in map(_single, _WORD.findall(token)):
            if word in self.single or any(word[:k] in self.single for k in range(2, 7)):
                return True
        return False

    def score(self, text: str) -> float:
        """Of a lower-case text."""
        tokens = text.split()
        several = set(tokens)
        if len(self.memo) > MEMO:
            self.memo.clear()
        for t in several.difference(self.memo):
            self.memo[t] = self.of_token(t)
        found = set(chain.from_iterable(map(self.memo.__getitem__, several)))
        alone = [i for i, t in enumerate(tokens) if t[1:2] in _BREAK]       # single letters, or letters set apart
        for a, b in _runs(alone):
            for _, words in self.restorer.apart(" ".join(tokens[max(0, a - 1):b + 2])):
                found |= self.weighed(words.split())
        weights = self.model.weights
        short = [i for i, t in enumerate(tokens[:-1]) if len(t) <= 3]
        for word, i in {tokens[i] + tokens[i + 1]: i for i in short}.items():
            if word in weights and _part(tokens[i], tokens[i + 1]):
                if " " not in self.restorer.joined(tokens[i], tokens[i + 1]):
                    found |= self.weighed([word])
        return self.model.score(found)


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """First and last of at least two places that follow each other."""
    out, first = [], 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] != places[k - 1] + 1:
            if k - first > 1:
                out.append((places[first], places[k - 1]))
            first = k
    return out


def fit(rows: list[list[int]], y: np.ndarray, width: int, steps: int = 800, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights (none negative: a feature only raises the score)."""
    at = np.fromiter(chain.from_iterable(rows), np.int64)
    of = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    w, b = np.zeros(width), -1.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(of, w[at], len(rows))
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g, gb = np.bincount(at, slope[of], width) + l2 * w, slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(0, w - 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9))
        b -= 0.2 * (mb / (1 - 0.9 ** t)) / (math.sqrt(vb / (1 - 0.999 ** t)) + 1e-9)
    return w, b


def train(docs: DataFrame, labels: DataFrame, cost: np.ndarray, train_rows: int = 12_000, least: int = 3) -> Model:
    """Features that mark toxic rows of the sample, and their weights."""
    spark = docs.sparkSession
    ids = label_sample(labels.select("doc_id").distinct(), labels, "toxic", 3, 1, train_rows)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_rows)
    chosen = {r["doc_id"]: float(r["y"] >= 0.5) for r in ids.collect()}
    if not chosen:
        return Model({}, 0.0)
    shared = spark.sparkContext.broadcast((chosen, cost))
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long"))     # at most 2 * train_rows
    once = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    few = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    sample = written(id_text(docs).join(wanted, "doc_id", "left_semi")
                     .withColumn("k", F.row_number().over(once)).filter("k = 1")
                     .withColumn("k", F.row_number().over(few)).filter(F.col("k") <= TEXTS).drop("k"), "toxic_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, cost = shared.value
        restorer, memo, bad, good = Restorer(cost), {}, Counter(), Counter()
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), texts(b)):
                (bad if labels[i] else good).update(features(t.decode(), restorer, memo))
        names = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()),
             pa.array([good[f] for f in names], pa.int64())], ["feature", "bad", "good"])

    n_bad = sum(chosen.values()) or 1.0
    n_good = (len(chosen) - sum(chosen.values())) or 1.0
    p, q = (F.col("bad") + 0.5) / (n_bad + 1), (F.col("good") + 0.5) / (n_good + 1)
    ranked = (sample.mapInArrow(count, "feature string, bad long, good long").groupBy("feature")
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .filter((F.col("bad") >= least) & (p > 4 * q)).withColumn("gain", F.col("bad") * F.log(p / q))
              .orderBy(F.desc("gain"), "feature"))
    names = [r["feature"] for r in ranked.collect()]
    code = {f: k for k, f in enumerate(names)}
    shared_code = spark.sparkContext.broadcast(code)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memo, code = Restorer(shared.value[1]), {}, shared_code.value
        for b in slices(batches):
            rows = [sorted(code[f] for f in features(t.decode(), restorer, memo) if f in code) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "on"])

    # at most TEXTS rows of 2 * train_rows ids, and features of their words
    rows = sorted((r["doc_id"], r["on"]) for r in sample.mapInArrow(active, "doc_id long, on array<int>").collect())
    y = np.array([chosen[i] for i, _ in rows])
    w, bias = fit([on for _, on in rows], y, len(names))
    return Model({f: float(w[k]) for f, k in code.items() if w[k] > 1e-3}, float(bias))


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and
    ``predicted`` (1 if the score is at least ``threshold``).

    NULL and empty texts have no feature and get the lowest score.  A NULL
    ``doc_id`` is not held out and not learned from; repeated rows give
    repeated results; an empty table gives an empty result, and without any
    label every score is 0.5.  A very long text is scored whole.  Other columns
    are not read.
    """
    cost = language_model(docs)
    model = train(docs, labels, cost, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, cost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in slices(batches, most=SLICE):
            scores = [scorer.score(raw.decode().lower()) for raw in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "score"])

    rows = id_text(docs).withColumn("held_out", held_out(3, 1)).select("doc_id", "text", "held_out")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
