"""Personal data by weak supervision.

Three labelers vote on every candidate span: the *pattern* labeler on its
strict form, the *gazetteer* labeler on known prefixes and endings, and the
*context* labeler on the words before it.  Each votes 1, 0 or abstains (-1).
Expectation-maximisation over the counts of vote patterns estimates the
labelers' reliabilities and the spans' posteriors; a logistic span classifier
is then trained on those posteriors and compiled into a column expression.

Built-in functions alone touch the data.  What reaches the driver are counts
by (kind, votes, length class): at most ``7 * 27 * 4`` rows whatever the
corpus, gathered after map-side aggregation.  The scan is written once, spans
without text, and classified where it lies: no text is ever shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import SPAN, bind, find, joined, ordered

# The base patterns (Java syntax; a run is read once), the
# strict forms, the gazetteers and the context words.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "name", "ssn", "iban"]
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+ [A-Z][a-z]+$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
}
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "name": r" (?:Smith|Jones|Brown|Miller|Martin|Bernard|Garcia|Lopez|Müller|Schmidt)$",
    "ssn": r"^[0-8]",
    "iban": r"^(?:AT|BE|CH|DE|ES|FR|GB|IT|LU|NL|PL|PT|SE)",
}
FOR = {
    "email": r"(?i)(?:e-?mail|contact|write to|mailto)\W*$", "ip": r"(?i)(?:\bip\b|address|host|server)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|payment)\W*$", "phone": r"(?i)(?:phone|tel|call|mobile|fax)\W*$",
    "name": r"(?i)(?:dear|by|from|contact)\W*$", "ssn": r"(?i)(?:ssn|social security)\W*$",
    "iban": r"(?i)(?:iban|account)\W*$",
}
AGAINST = r"(?i)(?:version|\bv|isbn|order|invoice|example|build|release|page|no\.)\W*$"
VIEW = 24                                 # code points of context before a span
SEEN = SPAN[:-1] + ",before:string>"
FOUND = f"struct<span:{SPAN},pattern:int,gazetteer:int,context:int,size:int>"


def luhn(value: Column) -> Column:
    """16 to 19 digits that pass the Luhn check."""
    def check(d: Column) -> Column:
        n = F.length(d)
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + bind(
            F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48, lambda x: F.when(i % 2 == 1, x).otherwise(
                F.when(x > 4, 2 * x - 9).otherwise(2 * x))))
        return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))

    return bind(F.regexp_replace(value, "[^0-9]", ""), check)


def candidates(text: Column) -> Column:
    none, digit = F.expr(f"cast(array() as array<{SEEN}>)"), text.rlike("[0-9]")
    n_digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    octets = lambda v: v.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    return F.concat(
        F.when(text.contains("@"), find(text, EMAIL, "email", view=VIEW)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), find(text, IP, "ip", ok=octets, view=VIEW)).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), find(text, CARD, "card", ok=luhn, view=VIEW)).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), find(text, PHONE, "phone", ok=lambda v: n_digits(v).between(8, 15), view=VIEW))
        .otherwise(none),
        F.when(text.rlike("(?:Mrs?|Ms|Dr|Prof)\\.? [A-Z]"), find(text, NAME, "name", view=VIEW)).otherwise(none),
        F.when(digit & text.rlike(SSN), find(text, SSN, "ssn", view=VIEW)).otherwise(none),
        F.when(digit & text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), find(text, IBAN, "iban", view=VIEW)).otherwise(none),
    )


def _by_kind(kind: Column, of: dict[str, str], test) -> Column:
    out = F.lit(False)
    for k, pattern in of.items():
        out = F.when(kind == k, test(pattern)).otherwise(out)
    return out


def votes(s: Column) -> Column:
    """The span with the three votes and its length class (0 to 3)."""
    before = s["before"]
    value, kind = s["value"], s["kind"]
    pattern = _by_kind(kind, STRICT, lambda p: value.rlike(p)).cast("int")
    gazetteer = F.when(_by_kind(kind, KNOWN, lambda p: value.rlike(p)), 1).otherwise(
        F.when(kind == "name", -1).otherwise(0))
    context = F.when(_by_kind(kind, FOR, lambda p: before.rlike(p)), 1).when(before.rlike(AGAINST), 0).otherwise(-1)
    size = F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int")
    return F.struct(s.dropFields("before").alias("span"), pattern.alias("pattern"), gazetteer.alias("gazetteer"),
                    context.alias("context"), size.alias("size"))


LABELERS = ["pattern", "gazetteer", "context"]


def reliabilities(counts: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Posterior that a span is personal data, by (kind, votes), from counts
    of those patterns, by expectation-maximisation.  Starts from the majority
    of the votes; a vote of -1 says nothing.  Counts are smoothed, so a
    labeler that never or always fires keeps a finite reliability."""
    post = {}
    for kind, v, _ in counts:
        cast = [x for x in v if x >= 0]
        post[kind, v] = (1 + sum(cast)) / (2 + len(cast))
    for _ in range(rounds):
        hit, miss = [1.6, 1.6, 1.6], [0.4, 0.4, 0.4]          # votes that agree, and that do not
        total: dict[str, list[float]] = {}
        for kind, v, n in counts:
            p = post[kind, v]
            t = total.setdefault(kind, [1.0, 2.0])
            t[0] += n * p
            t[1] += n
            for j, x in enumerate(v):
                if x >= 0:
                    agree = p if x == 1 else 1 - p
                    hit[j] += n * agree
                    miss[j] += n * (1 - agree)
        acc = [h / (h + m) for h, m in zip(hit, miss)]
        for kind, v, _ in counts:
            prior = total[kind][0] / total[kind][1]
            odds = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                if x >= 0:
                    odds += (1 if x == 1 else -1) * math.log(acc[j] / (1 - acc[j]))
            post[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def features(kind: str, v: tuple, size: int) -> list[int]:
    """Active features of a span (indices of the classifier's weights)."""
    out = [0, 1 + KINDS.index(kind)]
    at = 1 + len(KINDS)
    for j, x in enumerate(v):
        out.append(at + 3 * j + x + 1)
    return [*out, at + 3 * len(v) + size]


N_FEATURES = 1 + len(KINDS) + 3 * len(LABELERS) + 4


def train(rows: list[tuple], post: dict[tuple, float], steps: int = 400, l2: float = 1e-3) -> list[float]:
    """Logistic weights on counted feature patterns with soft labels."""
    data = [(features(k, v, size), post[k, v], n) for k, v, size, n in rows]
    total = sum(n for *_, n in data) or 1
    w = [0.0] * N_FEATURES
    for _ in range(steps):
        grad = [l2 * x for x in w]
        for active, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in active)))))
            for i in active:
                grad[i] += n * (p - y) / total
        w = [x - 2.0 * g for x, g in zip(w, grad)]
    return w


def probability(x: Column, w: list[float]) -> Column:
    """The trained classifier as an expression over a ``FOUND`` struct."""
    at = 1 + len(KINDS)
    kind = reduce(lambda acc, k: F.when(x["span"]["kind"] == k, F.lit(w[1 + KINDS.index(k)])).otherwise(acc), KINDS,
                  F.lit(0.0))
    score = F.lit(w[0]) + kind
    for j, name in enumerate(LABELERS):
        score += F.element_at(F.array(*[F.lit(v) for v in w[at + 3 * j:at + 3 * j + 3]]), x[name] + 2)
    end = at + 3 * len(LABELERS)
    score += F.element_at(F.array(*[F.lit(v) for v in w[end:end + 4]]), x["size"] + 1)
    return 1 / (1 + F.exp(-score))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found`` (candidate spans with their votes)."""
    text = F.col("text").cast("string")
    some = F.transform(candidates(text), votes)
    empty = F.expr(f"cast(array() as array<{FOUND}>)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.when(text.rlike(r"[0-9@]|(?:Mrs?|Ms|Dr|Prof)\.? [A-Z]"), some).otherwise(empty)
                       .alias("found"))
    return written(rows, "pii")


def find_personal_data(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_email``, ``n_ip``,
    ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` (all base spans, and
    the added kinds the classifier accepts), ``n_added`` and ``n_confirmed``
    (spans of any kind with a probability of at least ``accept``).

    NULL and empty texts have no spans; a table without any candidate (or
    without rows) leaves the classifier at its even start.  Repeated rows give
    repeated results, a NULL ``doc_id`` stays NULL; other columns are not
    read.  A span that two patterns find is listed under both kinds.
    """
    found = scan(docs)
    counted = (found.select(F.explode("found").alias("x")).select("x.span.kind", "x.pattern", "x.gazetteer",
                                                                  "x.context", "x.size")
               .groupBy("kind", *LABELERS, "size").count().orderBy("kind", *LABELERS, "size").collect())
    rows = [(r["kind"], (r["pattern"], r["gazetteer"], r["context"]), r["size"], r["count"]) for r in counted]
    merged: dict[tuple, int] = {}
    for kind, v, _, n in rows:
        merged[kind, v] = merged.get((kind, v), 0) + n
    weights = train(rows, reliabilities([(k, v, n) for (k, v), n in merged.items()]))
    base_kind = lambda x: x["span"]["kind"].isin(BASE)
    sure = lambda x: probability(x, weights) >= accept
    kept = found.select("doc_id", F.filter("found", lambda x: base_kind(x) | sure(x)).alias("kept"),
                        F.size(F.filter("found", sure)).cast("long").alias("n_confirmed"))
    spans = kept.select("doc_id", "n_confirmed", ordered(F.transform("kept", lambda x: x["span"]), KINDS,
                                                         by_kind_first=True).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"), "n_confirmed")
