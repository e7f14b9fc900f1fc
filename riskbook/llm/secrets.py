"""Secret scans with corpus-wide ownership frequency.

Candidates are found by patterns; their values are hashed, and for each hash
the distinct repositories and owners that hold it are counted over the whole
corpus.  A value that many owners hold, or that is in many repositories of
one, is a copied example; one that stays with few owners in few places and does
not look like a placeholder is taken for live.
In ``documents`` a row is a repository (``doc_id``) and ``source`` its owner.

Only built-in functions run here.  The scan is written once (spans alone, no
text).  Counting pre-aggregates (hash, owner) before any shuffle, so a value
pasted a million times is one row per task and owner.  The join that brings
the counts back spreads values that hold more than an even share of the spans
over tasks by a salt.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import find_hot_keys, salted_join
from .common import written
from .spans import find, joined, no_spans, ordered

# The base patterns of the scan, in Java syntax (possessive, so
# that a long run costs one pass), and tokens with a vendor's prefix.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
VENDOR = r"(?<![A-Za-z0-9_])(?:gh[opsur]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{16,}+)"
KINDS = ["assign", "access", "hex", "vendor"]
ANY = r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*+[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|gh[opsur]_|xox[abprs]-|sk_live_"""


def candidates(text: Column) -> Column:
    """All candidate spans of a text (NULL: none), by start then kind."""
    every = F.concat(
        find(text, ASSIGN, "assign", 1, lambda v: F.length(v) >= 8),
        find(text, ACCESS, "access"),
        find(text, HEX, "hex"),
        find(text, VENDOR, "vendor"),
    )
    return F.when(text.rlike(ANY), ordered(every, KINDS, by_kind_first=False)).otherwise(no_spans())


def placeholder(value: Column) -> Column:
    """Values that only stand for a secret: few different characters, or a
    word that says so."""
    different = F.size(F.array_distinct(F.filter(F.split(F.lower(value), ""), lambda c: c != "")))
    return (different < 5) | F.lower(value).rlike("example|changeme|placeholder|your[_-]|dummy|xxxx|12345678")


def scan(docs: DataFrame) -> DataFrame:
    """``row`` (unique), ``doc_id``, ``owner`` and ``found`` (array of spans
    whose value is replaced by its hash and a placeholder flag), written once."""
    hashed = F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.substring(F.sha2(s["value"], 256), 1, 32).alias("hash"), placeholder(s["value"]).alias("placeholder")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("owner"),
                       candidates(F.col("text").cast("string")).alias("found"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner",
                               hashed.alias("found")), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per value hash: ``n_owners`` and ``n_repositories`` that hold it."""
    held = scanned.filter(F.size("found") > 0).select(
        "row", "doc_id", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    each = held.groupBy("hash", "owner", F.coalesce(F.col("doc_id"), -F.col("row") - 1).alias("repository")).agg(
        F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def find_secrets(docs: DataFrame, shared_by: int = 3, copied_in: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_assign``, ``n_access``,
    ``n_hex``, ``base_sha256``, ``spans``, ``n_live`` and ``n_examples``
    (spans whose value is held by at least ``shared_by`` owners or in at least
    ``copied_in`` repositories, or is only a placeholder: an owner keeps a
    credential of its own in a few places, and a copied example is in many,
    be they of one owner), ``n_owners`` and ``n_repositories`` (the most that
    any of its values has) and ``labels`` (``kind:start:end:live`` or
    ``:example``, in span order).

    NULL and empty texts have no spans.  A NULL ``source`` counts as one
    owner, a NULL ``doc_id`` as a repository of its own; a repeated row counts
    as the same repository.  Work grows with a text and its matches, however
    long it is.  An empty table gives an empty result; other columns are not
    read.
    """
    scanned = scan(docs)
    each = written(scanned.filter(F.size("found") > 0).select(
        "row", F.posexplode("found").alias("k", "s")).select(
        "row", "k", F.col("s.hash").alias("hash"), F.col("s.placeholder").alias("placeholder")), "secret_values")
    hot = find_hot_keys(each.select("hash"), "hash")
    hot = replace(hot, keys=written(hot.keys, "hot_values"))
    live = salted_join(each, written(ownership(scanned), "secret_owners"), "hash", hot).withColumn(
        "live", (F.col("n_owners") < shared_by) & (F.col("n_repositories") < copied_in) & ~F.col("placeholder"))
    verdicts = live.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("k", "live"))).alias("verdict"),   # one text's spans
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_examples"),
        F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"))
    none = scanned.filter(F.size("found") == 0).select(
        "doc_id", "found", F.expr("cast(array() as array<struct<k:int,live:boolean>>)").alias("verdict"),
        F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_examples"),
        F.lit(0).cast("long").alias("n_owners"), F.lit(0).cast("long").alias("n_repositories"))
    some = scanned.filter(F.size("found") > 0).join(verdicts, "row").select(*none.columns)
    both = none.unionByName(some)
    base = F.filter("found", lambda s: s["kind"] != "vendor")

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    labels = F.array_join(F.zip_with("found", "verdict", lambda s, v: F.concat_ws(
        ":", s["kind"], s["start"], s["end"], F.when(v["live"], "live").otherwise("example"))), ",")
    return both.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("found")).alias("spans"), "n_live", "n_examples", "n_owners",
                       "n_repositories", labels.alias("labels"))


def mask(docs: DataFrame, shared_by: int = 3, copied_in: int = 10) -> DataFrame:
    """``docs`` with the live secrets of each text replaced by
    ``[secret]``; copied examples, clean, empty and NULL texts stay as they
    are, with all their columns and repeated rows."""
    columns = docs.columns
    rows = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*columns).alias("__doc"))
                   .filter(F.col("__doc.text").rlike(ANY)), "secret_texts")
    found = find_secrets(rows.select(F.col("__row").alias("doc_id"), "__doc.text", "__doc.source"), shared_by,
                         copied_in)
    marks = found.filter("n_live > 0").select(F.col("doc_id").alias("__row"), F.transform(
        F.filter(F.split("labels", ","), lambda x: x.endswith(":live")), lambda x: F.struct(
            F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"))).alias("__cut"))
    live = rows.join(marks, "__row", "left")
    text = F.col("__doc.text")

    def step(acc: Column, c: Column) -> Column:
        """Copy the text up to the cut, then the mark; overlapping cuts merge."""
        fresh = c["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(c["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit("[secret]"))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("__cut", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = live.select(*[(F.when(F.col("__cut").isNotNull(), masked).otherwise(text).alias("text") if c == "text"
                             else F.col("__doc")[c].alias(c)) for c in columns])
    return docs.filter(~F.coalesce(F.col("text").rlike(ANY), F.lit(False))).unionByName(changed)
