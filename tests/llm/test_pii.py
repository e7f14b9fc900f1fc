from __future__ import annotations

import random
import re
from hashlib import sha256

from riskbook.llm import pii

from .helpers import SCHEMA, odd_rows, table


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    bits = ["a.b@c.de", "x@y.z_w@v.u.t", "1.2.3.4.5", "300.1.1.1", "001.02.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "49927398716", "6011000990139424", "+1 (617) 555-2870", "+49.30.123456", "+1", "+12345678901234567", "é😀", " ", ", ", "@", "..", "5",
            "+1-2-", "12.34.56", "user%+x@host-1.example.com.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 2"]
    return [(i, rng.choice(["", " ", ". "]).join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for i in range(400)]


def test_base_spans_match_brute_force(spark):
    rows = corpus(5)
    got = {r["doc_id"]: r for r in pii.find_personal_data(table(spark, rows)).collect()}
    for i, t in rows:
        spans = brute(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE], t
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha256(text.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE] == [x for x in text.split(",") if x]


def test_expectation_maximisation_finds_the_unreliable_labeler():
    rng = random.Random(1)
    counts: dict = {}
    for _ in range(4000):
        y = rng.random() < .6
        v = tuple((y if rng.random() < acc else not y) * 1 if rng.random() < .9 else -1 for acc in (.95, .9, .55))
        counts["email", v] = counts.get(("email", v), 0) + 1
    post = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert post["email", (1, 1, 0)] > .9 and post["email", (0, 0, 1)] < .1
    assert post["email", (1, 0, 0)] > .4                  # the third labeler's vote weighs little
    w = pii.train([("email", v, 1, n) for (_, v), n in counts.items()], post)
    p = lambda v: sum(w[i] for i in pii.features("email", v, 1)) > 0
    assert p((1, 1, 1)) and p((1, 1, 0)) and not p((0, 0, 0)) and not p((0, 0, 1))


def test_added_kinds_need_the_classifier(spark):
    rows = [(i, f"mail: u{i}@site.com from 8.8.{i}.4, tel: +1 (617) 555-28{i:02d}") for i in range(40)]
    rows += [(100, "SSN: 123-45-6789 of Dr. Anna Smith"), (101, "order 000-12-3456")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert "ssn:5:16" in got[100]["spans"]
    assert got[101]["spans"] == "" and got[101]["n_added"] == 0
    assert got[3]["n_confirmed"] >= 3


def test_odd_rows(spark):
    rows = odd_rows() + [(20, "1" * 50_000), (21, "a." * 20_000 + "@"), (22, "+1" + " " * 30_000)]
    got = {(r["doc_id"], r["spans"]) for r in pii.find_personal_data(table(spark, rows)).collect()}
    assert {s for _, s in got} == {""}
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
