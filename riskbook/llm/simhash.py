"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments, and there is a table per segment
of the fingerprints under each segment value.  Two fingerprints with 2 differing
bits or fewer differ in one bit at most of some segment.  So each fingerprint
enumerates the Hamming ball of radius 1 around its segment values (only the
values with a bit cleared: of two values a bit apart, one has that bit more),
fetches what the tables hold under them, and verifies the complete distance.

A table entry with many fingerprints (near copies that agree in 32 bits) would
need all pairs of them.  It is refined by the other segment instead: the
fingerprints that meet such an entry are keyed by a segment's ball value
together with the whole other segment.  Members of such a fine entry differ
from its key by one bit, so it holds 65 fingerprints at most and a star links
it; two of them within 2 bits always share one.  Nothing is dropped: a pair
whose common entry is large is among the refined fingerprints with both ends.

Equal texts meet in one fingerprint before anything is enumerated, so a group
of copies holding a third of all rows is one row per task; rows get their
component back by a join that spreads such a fingerprint over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import find_hot_keys, salted_join
from ..session import shuffle_partitions
from .common import id_text, slices, texts, written
from .graph import components

SEED = 42
BITS = 64
_SEGMENTS, _WIDTH = 2, 32

# The eight bits of each byte spread over eight byte lanes, for counting.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()                 # bytes.lower() changes A-Z alone
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(),
                                                    ends[shingle - 1:].tolist())]


def fingerprints(raw: list[bytes], shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is set in over
    half of the shingle hashes; no words give 0."""
    each = [_shingle_hashes(t, shingle) for t in raw]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    out = np.zeros(len(raw), np.uint64)
    if not sizes.sum():
        return out
    h = np.fromiter((x for xs in each for x in xs), np.uint64, int(sizes.sum()))
    lanes = _SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)].view(np.uint8).reshape(-1, 64)
    full = np.flatnonzero(sizes)
    ones = np.add.reduceat(lanes, np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0, dtype=np.uint32)
    bits = (2 * ones.astype(np.int64) > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_rows(docs: DataFrame, shingle: int, *more: str) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) and long
    columns ``more`` of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            fp = fingerprints(texts(b), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *more])

    return id_text(docs, *more).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _entries(distinct: DataFrame) -> DataFrame:
    """The tables: ``k`` (which segment), ``v`` (its value), ``fp``."""
    return distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k).alias("v"))
                                                     for k in range(_SEGMENTS)])).alias("e")).select("e.*", "fp")


def _probes(distinct: DataFrame, radius: int) -> DataFrame:
    """The ball around every segment value, as far as it is below the value:
    ``k``, ``v``, ``fp``."""
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(_WIDTH)]) if radius else F.array().cast("array<bigint>")
    own = _entries(distinct)
    ball = F.concat(F.array("v"), F.transform(F.filter(masks, lambda m: F.col("v").bitwiseAND(m) != 0),
                                              lambda m: F.col("v").bitwiseXOR(m)))
    return own.select("k", F.explode(ball).alias("v"), "fp")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def candidates(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """What the probes fetch from the tables: ``a``, ``b`` and their distance
    ``bits``.  Fingerprints under one value meet once."""
    table = entries.select("k", "v", F.col("fp").alias("held"))
    met = probes.join(table, ["k", "v"]).filter((F.col("fp") != F.col("held")))
    once = (_segment_of("fp") != _segment_of("held")) | (F.col("fp") < F.col("held"))
    return met.filter(once).select(F.least("fp", "held").alias("a"), F.greatest("fp", "held").alias("b"),
                                   _apart("fp", "held").alias("bits"))


def _segment_of(name: str) -> Column:
    return F.when(F.col("k") == 0, _segment(F.col(name), 0)).otherwise(_segment(F.col(name), 1))


def refined(crowd: DataFrame) -> DataFrame:
    """Edges between the fingerprints of crowded entries whose closure is that
    of all their pairs within 2 bits: every fingerprint is entered under itself
    with each bit flipped, and the members of an entry hang on the smallest."""
    flips = [m - (1 << 64) if m >> 63 else m for m in (1 << b for b in range(BITS))]
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *flips]])
    fine = crowd.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    groups = fine.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()
    return star.filter(_apart("a", "b") <= 2)


def links(distinct: DataFrame, max_bits: int = 2, crowded: int = 64) -> DataFrame:
    """Edges ``a < b`` between distinct fingerprints (column ``fp``) whose
    closure is that of all pairs within ``max_bits`` differing bits.  A table
    entry of more than ``crowded`` fingerprints is refined, whatever its size."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2: the segment balls have radius 1")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    dealt = distinct.repartition(shuffle_partitions(distinct.sparkSession), F.xxhash64("fp"))   # the balls fill every core
    entries, probes = _entries(dealt), _probes(dealt, max_bits // _SEGMENTS)
    large = written(entries.groupBy("k", "v").agg(F.count("*").alias("n")).filter(F.col("n") > crowded)
                    .select("k", "v"), "crowded_entries")
    near = F.col("bits") <= max_bits
    if large.isEmpty():
        return candidates(entries, probes).filter(near).select("a", "b").distinct()
    calm = candidates(entries.join(large, ["k", "v"], "left_anti"), probes)
    crowd = probes.join(large, ["k", "v"], "left_semi").select("fp").distinct()
    fine = refined(crowd) if max_bits == 2 else _one_bit(crowd)
    return calm.filter(near).select("a", "b").unionByName(fine).distinct()


def _one_bit(crowd: DataFrame) -> DataFrame:
    """Pairs of ``crowd`` that differ in one bit."""
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in (1 << b for b in range(BITS))])
    flipped = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
    return flipped.join(crowd.withColumnRenamed("fp", "b"), "b").filter("fp < b").select(F.col("fp").alias("a"), "b")


def linked(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` (one row per ``fp``) with the ``root`` of their component,
    NULL for a fingerprint without links."""
    reached = components(links(nodes.select("fp"), max_bits))        # node, root: linked fingerprints alone
    return nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lowercase
    hex digits) and ``component_id``, the smallest ``doc_id`` that links reach.

    NULL and empty texts have fingerprint zero and are linked like any other;
    fewer words than a shingle are hashed as one.  Repeated rows give repeated
    results.  Rows with a NULL ``doc_id`` are fingerprinted and linked; their
    component is the smallest other id reached (NULL if there is none).  An
    empty table gives an empty result; other columns are not read.
    """
    rows = written(fingerprint_rows(docs, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = linked(nodes, max_bits)
    roots = (least.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = (least.join(roots, "root", "left")
             .select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return salted_join(rows, by_fp, "fp", find_hot_keys(rows.select("fp"), "fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_copies(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group, all columns kept: the one with the
    smallest ``doc_id``, NULLs last, and of those the first written.

    Groups are of rows, not of ids: rows whose ``doc_id`` is NULL or repeats
    are copies only if their texts are.  Rows are written with an id of their
    own; texts move once, by that id.
    """
    columns = docs.columns
    rows = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*columns).alias("__doc")),
                   "dedup_texts")
    named = rows.select(F.col("__row").alias("doc_id"), F.col("__doc.text").alias("text"),
                        F.col("__doc.doc_id").cast("long").alias("name"))
    found = written(fingerprint_rows(named, shingle, "name"), "fingerprints")
    first = F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", F.col("doc_id").alias("row")))
    nodes = found.groupBy("fp").agg(first.alias("first"))
    kept = (linked(nodes, max_bits).groupBy(F.coalesce("root", "fp").alias("group"))
            .agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")))
    # texts move the same way at every size: dealt by row id, next to the ids that stay
    return rows.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*[F.col("__doc")[c].alias(c) for c in columns])
