"""The whole pipeline against five plain-Python stages that share no code
with the operators: NULLs, repeated ids and rows, a hot source, copies."""

from __future__ import annotations

import random
import re
import struct
from collections import defaultdict
from hashlib import sha256

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import SCHEMA
from .test_decontaminate import brute as leaks
from .test_secrets import KINDS, brute as secret_spans
from .test_simhash import fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    """Words in windows of ``n`` words found twice or more."""
    seen = defaultdict(list)
    for i in range(len(words) - n + 1):
        seen[tuple(words[i:i + n])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def passes(text):
    words = WORD.findall(text or "")
    return (len(words) >= 10 and 100 * covered(words, 5) <= 20 * len(words)
            and 100 * covered(words, 20) <= 15 * len(words) and covered(words, 101) == 0)


def first_of_groups(rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[label[k]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def masked(rows):
    owners, places = defaultdict(set), defaultdict(set)
    for k, (i, t, _, source) in enumerate(rows):
        for *_, value in secret_spans(t):
            owners[value].add(source)
            places[value].add((source, i if i is not None else f"row {k}"))
    out = []
    for i, t, lang, source in rows:
        spans = sorted(secret_spans(t), key=lambda s: (s[0], KINDS.index(s[2])))
        live = [(a, b) for a, b, _, v in spans if len(owners[v]) < 3 and len(places[v]) < 10 and len(set(v.lower())) >= 5
                and not re.search("example|changeme|placeholder|your[_-]|dummy|xxxx|12345678", v.lower())]
        text, at = "", 0
        for a, b in live:
            if a >= at:
                text += t[at:a] + "[secret]"
            at = max(at, b)
        out.append((i, text + t[at:], lang, source))
    return out


def fixture():
    rng = random.Random(77)
    vocab = [f"{a}{b}" for a in "alpha beta gamma delta omega sigma kappa".split() for b in range(60)]
    items = [(f"item-{k}" if k % 2 else str(k), " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 25)))) for k in range(12)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    shared = "token = \"%032x\"" % 0x9f3a7c5e1db82f604c6ad17e35b98f20
    rows = [(None, None), (1, ""), (2, "too few words"), (3, " ".join(words(4) * 30)), (4, "one two three four five " * 8)]
    base = [" ".join(words(rng.randint(40, 120))) for _ in range(40)]
    rows += [(100 + k, t) for k, t in enumerate(base)]
    rows += [(200 + k, base[k]) for k in range(6)]                       # exact copies
    rows += [(50, base[7].upper()), (None, base[8]), (None, base[9]), (None, " ".join(words(50)))]
    rows += [(7, " ".join(words(60))), (7, " ".join(words(60)))]         # an id shared by two texts
    rows += [(300 + k, " ".join(words(20) + [t] + words(20))) for k, (_, t) in enumerate(items[:6])]
    rows += [(400 + k, " ".join([*words(30), shared, *words(30)])) for k in range(12)]
    rows += [(500 + k, f"{' '.join(words(25))} é password: {rng.getrandbits(120):x}😀 AKIA{'ABCDEFGH0123'}{k:04d} {' '.join(words(9))}")
             for k in range(6)]
    rows += [(600, " ".join(words(30)) + " api_key='" + "deadbeefcafe0123" * 3 + "' api_key=your_example_key " + " ".join(words(3)))]
    rows += [rows[-1]]
    return [(i, t, "en", "hot" if k % 3 else f"s{k % 4}") for k, (i, t) in enumerate(rows)], items


def test_pipeline_equals_five_plain_stages(spark, tmp_path):
    rows, items = fixture()
    full = [(*r, len(r[1] or ""), "s", "p", "r", "f") for r in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if passes(r[1])]
    single = first_of_groups(kept)
    named = list(enumerate(r[1] for r in single))
    found = {k for k, _ in leaks(named, items, 0.6, 0.6, 0.5)}
    clean = [r for k, r in enumerate(single) if k not in found]
    last = masked(clean)
    assert len(rows) > len(kept) > len(single) > len(clean) and any("[secret]" in t for _, t, *_ in last)
    assert any("%032x" % 0x9f3a7c5e1db82f604c6ad17e35b98f20 in t for _, t, *_ in last)       # the copied example stays

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t, *_ in last:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
