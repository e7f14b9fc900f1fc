"""Quality classifier: a sparse rule ensemble.

Small trees are grown on statistics of the labelled texts; every path from a
root is a conjunctive rule.  A lasso-penalised logistic regression keeps few
of the rules, and those are compiled into one Spark column expression over
the statistics.

Statistics are taken once per text and written (``len(STATISTICS)`` numbers a
row, no text); learning uses at most about ``train_rows`` labelled rows,
chosen by a hash of ``doc_id``.  Scoring needs no Python and no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, held_out, id_text, slices, texts, written

STATISTICS = ["n_words", "word_length", "upper", "digit", "symbol", "exclamation", "stop", "comma", "pipe",
              "not_ascii", "distinct_words", "top_word", "stutter", "duplicate_lines", "line_words", "long_words",
              "short_words"]
_NOT = {k: bytes(set(range(256)) - set(v)) for k, v in {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~=_/\\{}[]",
    "not_ascii": bytes(range(0xC0, 0x100))}.items()}


def statistics(text: bytes) -> tuple[float, ...]:
    """The numbers of one text; shares are of its words or characters."""
    words = text.split()
    n = len(words) or 1
    chars = len(text.translate(None, WORD_SPACE)) or 1
    count = {k: len(text.translate(None, drop)) for k, drop in _NOT.items()}
    by = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    sizes = list(map(len, words))
    return (float(len(words)), chars / n, count["upper"] / chars, count["digit"] / chars, count["symbol"] / chars,
            text.count(b"!") / n, text.count(b".") / n, text.count(b",") / n, text.count(b"|") / n,
            count["not_ascii"] / chars, len(by) / n, (max(by.values()) if by else 0) / n, stutter / n,
            1 - len(set(lines)) / len(lines) if lines else 0.0, n / (len(lines) or 1),
            sum(s > 12 for s in sizes) / n, sum(s < 3 for s in sizes) / n)


def statistics_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([statistics(t) for t in texts(b)], np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in got.T]], ["doc_id", *STATISTICS])

    return id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} float" for s in STATISTICS))


Condition = tuple[int, float, bool]              # statistic, threshold, above it
Rule = tuple[Condition, ...]


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, bins: int = 24,
         least: int = 10) -> list[Rule]:
    """All paths of one tree: at each node the best squared-error split among
    quantiles of a random half of the statistics."""
    rules: list[Rule] = []

    def node(rows: np.ndarray, path: Rule) -> None:
        if len(path) == depth or len(rows) < 2 * least:
            return
        best, cut = 1e-9, None
        t = y[rows]
        for j in rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
            v = x[rows, j]
            for c in np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower")):
                up = v > c
                k = int(up.sum())
                if least <= k <= len(rows) - least:
                    gain = (t[up].mean() - t[~up].mean()) ** 2 * k * (len(rows) - k) / len(rows)
                    if gain > best:
                        best, cut = gain, (int(j), float(c))
        if cut is None:
            return
        j, c = cut
        up = x[rows, j] > c
        for above in (True, False):
            rule = (*path, (j, c, above))
            rules.append(rule)
            node(rows[up == above], rule)

    node(np.arange(len(x)), ())
    return rules


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, c, above in rule:
        out &= (x[:, j] > c) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps."""
    n = len(z)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (1 + (np.linalg.norm(z, 2) ** 2) / n)
    for _ in range(steps):
        slope = (1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30))) - y) / n
        new = v - step * (z.T @ slope)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        newb = vb - step * slope.sum()
        far = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / far * (new - w), newb + (t - 1) / far * (newb - b)
        w, b, t = new, newb, far
    return w, float(b)


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, c, above in rule:
                col = F.col(STATISTICS[j])
                test = test & ((col > F.lit(c)) if above else (col <= F.lit(c)))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-4,
        seed: int = 7) -> RuleEnsemble:
    """Trees on bootstrap halves, then the lasso over their paths (each
    distinct set of covered rows once, the shortest path first)."""
    if not len(y):
        return RuleEnsemble([], 0.0)
    rng = np.random.default_rng(seed)
    rules: dict[bytes, Rule] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 4000), replace=True)
        for rule in sorted(grow(x[rows], y[rows], depth, rng), key=len):
            hit = holds(x, rule)
            if 0 < hit.sum() < len(y):
                rules.setdefault(np.packbits(hit).tobytes(), rule)
    found = list(rules.values())
    if not found or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble([], float(np.log(p / (1 - p))))
    z = np.column_stack([holds(x, r) for r in found]).astype(np.float64)
    w, b = lasso(z, y, penalty)
    return RuleEnsemble([(r, float(v)) for r, v in zip(found, w) if abs(v) > 1e-4], b)


def label_sample(rows: DataFrame, labels: DataFrame, label: str, buckets: int, held: int, most: int) -> DataFrame:
    """About ``most`` rows of ``rows`` that are labelled and not held out, with
    the label as ``y`` (rows that repeat a label: its mean)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
             .filter("doc_id is not null and y is not null").withColumn("held", held_out(buckets, held))
             .filter("not held").groupBy("doc_id").agg(F.avg("y").alias("y")))
    n = known.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(known.filter(chance < min(1.0, most / max(1, n))), "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and
    ``predicted`` (1 if the score is at least ``threshold``).

    NULL and empty texts are scored by their statistics (all zero).  A NULL
    ``doc_id`` is not held out and not learned from; repeated rows give
    repeated results; an empty table gives an empty result, and without any
    label every score is 0.5.  Other columns are not read.
    """
    stats = written(statistics_rows(docs), "statistics")
    sample = label_sample(stats, labels, "quality", 5, 0, train_rows).limit(2 * train_rows)
    got = sorted(tuple(r) for r in sample.select("doc_id", "y", *STATISTICS).collect())
    data = np.array(got, np.float64).reshape(-1, 2 + len(STATISTICS))
    model = fit(data[:, 2:], (data[:, 1] >= 0.5).astype(float))
    scored = stats.select("doc_id", held_out(5, 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
