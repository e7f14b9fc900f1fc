from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import sha256

from riskbook.llm import secrets

from .helpers import SCHEMA, odd_rows, table

ASSIGN = re.compile(r"""(?:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ["assign", "access", "hex", "vendor"]


def brute(text):
    """(start, end, kind, value) of the base patterns, by start then kind."""
    t = text or ""
    out = [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def corpus(seed):
    rng = random.Random(seed)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40]))) for _ in range(6)]
    keys = ["AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(rng.choice([11, 12, 16]))) for _ in range(4)]
    bits = ["😀 é ", "token = \"%s\"", "PassWord:%s ", "api_key=%s", "apikey='%s'", "secret %s", "passwd =   %s\n", "%s%s", "x", " ",
            "AKIAAKIA", "AKIA", "token=short", "Token == a.b/c-d=e+f_g", "tokentoken=%s", "password=%s=%s"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(bits)
            parts.append(b % tuple(rng.choice(values + keys) for _ in range(b.count("%s"))))
        rows.append((i, rng.choice(["", " ", ", "]).join(parts), "en", rng.choice(["a", "b", "c", "d", None])))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(2)
    got = {r["doc_id"]: r for r in secrets.find_secrets(table(spark, rows)).collect()}
    owners, places = defaultdict(set), defaultdict(set)
    for i, t, _, owner in rows:
        for *_, value in brute(t):
            owners[value].add(owner)
            places[value].add((owner, i))
    for i, t, *_ in rows:
        spans = brute(t)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k in KINDS[:3])
        text = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)
        assert r["spans"] == text and r["base_sha256"] == sha256(text.encode()).hexdigest()
        live = [len(owners[v]) < 3 and len(places[v]) < 10 and len(set(v.lower())) >= 5 for *_, v in spans]
        assert (r["n_live"], r["n_examples"]) == (sum(live), len(live) - sum(live))
        assert r["n_owners"] == max([len(owners[v]) for *_, v in spans], default=0)
        assert r["n_repositories"] == max([len(places[v]) for *_, v in spans], default=0)
        assert [x.split(":")[3] for x in r["labels"].split(",") if x] == ["live" if x else "example" for x in live]


def test_vendor_tokens_are_added(spark):
    text = "ghp_" + "a1B2c3D4" * 5 + " and sk_live_ABCDEFGH12345678 xghp_" + "z" * 40
    r = secrets.find_secrets(table(spark, [(1, text)])).first()
    assert r["spans"] == "vendor:0:44,vendor:49:73" and r["base_sha256"] == sha256(b"").hexdigest()


def test_mask_replaces_live_values_alone(spark):
    shared = "0123456789abcdef" * 2
    rows = [(i, f"é token = \"{shared}\" end", "en", f"s{i}") for i in range(4)]
    own = "deadbeefcafe0123" * 2
    rows += [(10, f"a {own} b password={own} c", "en", "z"), (11, "nothing", "en", "z"), (12, None, "en", "z")]
    got = {r["doc_id"]: r["text"] for r in secrets.mask(table(spark, rows)).collect()}
    assert got[10] == "a [secret] b [secret] c"
    assert {i: got[i] for i in got if i != 10} == {r[0]: r[1] for r in rows if r[0] != 10}


def test_odd_rows(spark):
    df = table(spark, odd_rows())
    assert len(secrets.find_secrets(df).collect()) == len(odd_rows())
    masked = secrets.mask(df)
    assert masked.columns == df.columns
    assert sorted(map(str, masked.collect())) == sorted(map(str, df.collect()))
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_value_copied_within_one_owner_is_an_example(spark):
    """3,000 documents of one source hold one value, nine another; a third is
    nine times in one document, and rows without id are places of their own."""
    wide, few, one, bare = ("%032x" % (0x9f3a7c5e1db82f604c6ad17e35b98f20 + k) for k in range(4))
    rows = [(i, f"key {wide}", "en", "hot") for i in range(3000)] + [(5000 + i, f"key {few}", "en", "hot") for i in range(9)]
    rows += [(9000, f"key {one} " * 9, "en", "hot")] + [(None, f"key {bare}", "en", "hot")] * 10
    got = defaultdict(set)
    for r in secrets.find_secrets(table(spark, rows)).collect():
        got[r["n_repositories"]].add((r["n_owners"], r["n_live"], r["n_examples"]))
    assert got == {3000: {(1, 0, 1)}, 9: {(1, 1, 0)}, 1: {(1, 9, 0)}, 10: {(1, 0, 1)}}
    masked = secrets.mask(table(spark, rows)).filter("text like '%[secret]%'").collect()
    assert len(masked) == 10
