"""Mixing sources to target weights with a multivariate-hypergeometric tree.

A text is a run of words, cut into blocks of ``block_words``.  Each source's
target is water-filled: its weight's share of all words, at most ``most`` times
its own words, the excess going to the others by weight.  The mix takes a
source's blocks whole as often as they fit into the target, and of a random
permutation of them as many as the rest needs, the last one in part; taken
words equal the target's whole words.

That gives each source an exact quota of draws.  A binary tree over the output
shards splits the vector of quotas: at each node one half of the draws goes
left, its make-up drawn from the multivariate hypergeometric distribution
(source after source, each hypergeometric given the ones before), so that the
shards are alike, equal in size and add up to the quotas.  A source's draws
are its permuted blocks in order, pass after pass, and each shard owns the next
run of them, so no draw is in two shards.  Each shard then shuffles its own.

Everything is DataFrame functions.  Permuted places come in two steps: blocks
are dealt by source and leading bits of their hash, about ``_BUCKET`` to a
bucket, ranked there, and the buckets' sizes are summed up; so a source with a
third of all words is as many tasks as its buckets.  A draw finds its shard
through the cell of its source's draws it lies in (there are as many cells as
shards), which holds the few shard starts inside it.

What one task gathers: one bucket, one shard (about ``shard_words`` words), or
tables of one row per source, per bucket, or per source and shard.  Quotas of
a node are one array with an entry per source.

Odd input: NULL texts have size 0; rows of size 0 are in no draw and have taken
0.  A NULL source is a source of its own, last in order.  NULL and repeated ids
do no harm, as rows get a number of their own.  Order comes from hashes of id
and text, so reruns agree; rows alike in both are interchangeable.  A very
long text is many blocks.  An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import bounded_broadcast
from .common import written
from .spans import bind

WORD = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 60
_BUCKET = 1 << 13
_WHOLE = "decimal(38,0)"


class Mix(NamedTuple):
    rows: DataFrame      # row, doc_id, mark, source, size, source_size, target
    draws: DataFrame     # shard, place, row, doc_id, pass, first_word, words


def _targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source: ``i`` (its place), ``source_size``, ``blocks``, ``target``
    (double) and ``goal`` (the target's whole words).

    Sources reach their cap in order of cap / weight; one is capped if its cap
    is below its share of what the ones before it left.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("blocks"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("i", place).withColumn("w", F.get(cycle, F.col("i") % len(weights)).cast("long"))
    common = math.lcm(*weights)
    everything = Window.partitionBy()
    cap = F.col("source_size").cast(_WHOLE) * most
    per = (per.withColumn("cap", cap).withColumn("all", F.sum("source_size").over(everything).cast(_WHOLE))
           .withColumn("weight", F.sum("w").over(everything))
           .withColumn("steep", F.call_function("div", F.col("cap") * common, F.col("w"))))
    earlier = Window.orderBy("steep", "i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    heavy = F.col("weight") - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    per = per.withColumn("capped", F.col("cap") * heavy <= left * F.col("w"))
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    others = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    per = per.withColumn("num", (rest * F.col("w")).cast(_WHOLE)).withColumn("den", others)
    share = F.col("num").cast("double") / F.col("den").cast("double")
    whole = F.call_function("div", F.col("num"), F.col("den").cast(_WHOLE))
    return per.select("i", "source", "source_size", "blocks",
                      F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"),
                      F.when(F.col("capped"), F.col("cap").cast("long")).otherwise(whole).alias("goal"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``population`` are ``marked``: the inverse of
    the distribution at ``u``, summed over nine deviations to either side."""
    n, k, d = (c.cast("double") for c in (population, marked, draws))
    mean = F.when(population > 0, k * d / n).otherwise(0.0)
    spread = F.when(population > 1, F.sqrt(F.greatest(mean * (1 - k / n) * (n - d) / (n - 1), F.lit(0.0)))).otherwise(0.0)

    def ends(r: Column) -> Column:
        reach = r["spread"] * 9 + 9
        return F.struct(
            F.greatest(F.lit(0).cast("long"), draws + marked - population, F.floor(r["mean"] - reach)).alias("lo"),
            F.least(draws, marked, F.ceil(r["mean"] + reach)).alias("hi"))

    def odds(x: Column) -> Column:            # of x + 1 against x
        x = x.cast("double")
        return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    def draw(r: Column) -> Column:
        steps = F.when(r["hi"] > r["lo"], F.sequence(r["lo"], r["hi"] - 1)).otherwise(
            F.array().cast("array<bigint>"))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), r["lo"].alias("x"))

        def grow(a: Column, x: Column) -> Column:
            w = a["w"] * odds(x)
            return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), a["x"].alias("x"))

        def walk(limit: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                w = a["w"] * odds(x)
                return F.when(a["sum"] > limit, a).otherwise(
                    F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), (a["x"] + 1).alias("x")))
            return F.aggregate(steps, start, step, lambda a: a["x"])

        return bind(u * F.aggregate(steps, start, grow, lambda a: a["sum"]), walk)

    return bind(F.struct(mean.alias("mean"), spread.alias("spread")), lambda r: bind(ends(r), draw))


def _left(quotas: Column, node: Column, seed: str) -> Column:
    """Of a node's quotas, those of its left half."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def step(a: Column, q: Column) -> Column:
        x = hypergeometric(a["population"], q, a["draws"], _uniform(F.lit(seed), node, F.size(a["out"])))
        return bind(x, lambda taken: F.struct(
            (a["population"] - q).alias("population"), (a["draws"] - taken).alias("draws"),
            F.concat(a["out"], F.array(taken)).alias("out")))

    zero = bind(total, lambda t: F.struct(t.alias("population"), F.floor(t / 2).alias("draws"),
                                          F.array().cast("array<bigint>").alias("out")))
    return F.aggregate(quotas, zero, step, lambda a: a["out"])


def split_quotas(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """``quotas`` (one row: an array ``quotas`` with the draws of each source)
    split over 2 ** levels shards: ``shard, quotas``."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(levels):
        halves = nodes.select("node", "quotas", _left(F.col("quotas"), F.col("node"), seed).alias("left"))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("n")).select("n.*")
        if level == 5:
            nodes = nodes.repartition("node")       # deeper levels are spread over tasks
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), "quotas")


def _permuted(rows: DataFrame, sources: DataFrame, block_words: int, seed: str, bits: int) -> DataFrame:
    """Every block: ``i, row, doc_id, block, words`` and, in its source's
    permutation, its ``place`` and the words ``before`` it."""
    here = rows.filter(F.col("size") > 0).join(
        sources.select(F.col("source").alias("s"), "i"), F.col("source").eqNullSafe(F.col("s")))
    blocks = here.select("i", "row", "doc_id", "size", "mark", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    tag = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark", "block"))
    key = F.conv(F.substring(tag, 1, _KEY_BITS // 4), 16, 10).cast("long")
    blocks = blocks.select("i", "row", "doc_id", "block", key.alias("key"),
                           F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"))
    blocks = blocks.withColumn("bucket", F.shiftright("key", _KEY_BITS - bits))
    order = Window.partitionBy("i", "bucket").orderBy("key", "doc_id", "block", "row")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    dealt = written(blocks.withColumn("rank", F.row_number().over(order) - 1)
                    .withColumn("upto", F.coalesce(F.sum("words").over(running), F.lit(0))), "mix_blocks")
    buckets = dealt.groupBy("i", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    lower = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = bounded_broadcast(written(buckets.select(
        "i", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("w0")), "mix_buckets"))
    return dealt.join(starts, ["i", "bucket"]).select(
        "i", "row", "doc_id", "block", "key", "words", (F.col("n0") + F.col("rank")).alias("place"),
        (F.col("w0") + F.col("upto")).alias("before"))


def _cells(shards: DataFrame, quotas: DataFrame, n: int) -> DataFrame:
    """Per source and cell (the n-th part of its draws): ``first``, the shard
    at the cell's start, and ``starts``, where further shards begin in it."""
    per = shards.select("shard", F.posexplode("quotas").alias("i", "q"))
    before = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (per.withColumn("start", F.coalesce(F.sum("q").over(before), F.lit(0)))
              .join(quotas.select("i", "quota"), "i").filter("shard > 0 AND start < quota")
              .groupBy("i", F.call_function("div", F.col("start") * n, F.col("quota")).alias("cell"))
              .agg(F.collect_list("start").alias("starts")))
    every = quotas.filter("quota > 0").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
                                              .alias("cell"))
    lower = Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(starts, ["i", "cell"], "left").select(
        "i", "cell", F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts")).withColumn(
        "first", F.coalesce(F.sum(F.size("starts")).over(lower), F.lit(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 256,
        shard_words: int = 1 << 22, seed: str = "mix") -> Mix:
    """``rows`` with their source's target, and the mix itself as ``draws``:
    the words of a row from ``first_word`` on that stand at ``place`` of
    ``shard``.  ``weights`` go round the sources in order of their names.
    There are 2 ** k shards of about ``shard_words`` words.  See the module
    for odd input."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = written(plain.select("row", "doc_id", "source", size.alias("size"),
                                 F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("mark"))
                    .withColumn("blocks", F.call_function("div", F.col("size") + (block_words - 1),
                                                          F.lit(block_words).cast("long"))), "mix_rows")
    sources, _ = bounded_broadcast(written(_targets(sized, weights, most), "mix_sources"))
    total = sources.agg(F.sum("source_size").alias("words"), F.sum("blocks").alias("blocks")).first()
    levels = max(0, math.ceil(math.log2(max(total["words"] or 0, 1) / shard_words)))
    bits = min(_KEY_BITS, max(0, math.ceil(math.log2(max(total["blocks"] or 0, 1) / _BUCKET))))

    passes = F.call_function("div", F.col("goal"), F.nullif("source_size", F.lit(0)))
    need = sources.filter("source_size > 0").select("i", "blocks", passes.alias("passes"),
                                                    (F.col("goal") - passes * F.col("source_size")).alias("rest"))
    need, _ = bounded_broadcast(written(need, "mix_needs"))
    blocks = written(_permuted(sized, sources, block_words, seed, bits), "mix_places")
    more = blocks.join(need, "i").groupBy("i").agg(
        F.max(F.col("passes") * F.col("blocks")).alias("full"), F.count_if(F.col("before") < F.col("rest")).alias("part"))
    quotas = written(more.select("i", (F.col("full") + F.col("part")).alias("quota")), "mix_quotas")
    by_place = sources.join(quotas, "i", "left").select(
        "i", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    vector = by_place.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "quota"))), lambda x: x["quota"])
                          .alias("quotas"))
    shards = written(split_quotas(vector, levels, seed), "mix_shards")
    cells, _ = bounded_broadcast(written(_cells(shards, quotas, 1 << levels), "mix_cells"))

    times = (F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)).cast("long")
    quota, _ = bounded_broadcast(quotas)
    draws = blocks.join(need.drop("blocks").join(quota, "i").join(sources.select("i", "blocks"), "i"), "i").withColumn(
        "times", times).filter("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    part = F.least(F.col("words"), F.col("rest") - F.col("before"))
    draws = draws.withColumn("draw", F.col("pass") * F.col("blocks") + F.col("place")).withColumn(
        "cell", F.call_function("div", F.col("draw") * (1 << levels), F.col("quota")))
    draws = draws.join(cells, ["i", "cell"])
    shard = F.col("first") + F.size(F.filter("starts", lambda s: s <= F.col("draw")))
    draws = draws.select(shard.alias("shard"), "row", "doc_id", "pass", (F.col("block") * block_words).alias("first_word"),
                         F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(part).alias("words"),
                         F.xxhash64(F.lit(seed), "key", "pass").alias("turn"))
    local = Window.partitionBy("shard").orderBy("turn", "row", "first_word", "pass")
    draws = written(draws.withColumn("place", F.row_number().over(local) - 1).select(
        "shard", "place", "row", "doc_id", "pass", "first_word", "words"), "mix_draws")
    targets = sources.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "doc_id", "mark", "source", "size", "source_size", "target")
    return Mix(rows, draws)


def taken(mixed: Mix) -> DataFrame:
    """``rows`` of a mix with the words that its draws take of each."""
    words = mixed.draws.groupBy("row").agg(F.sum("words").alias("taken"))
    return mixed.rows.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def shard_texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """``shard, place, doc_id, text``: the mix's words, one space apart.
    Texts come from ``docs``, the table that was mixed, by id and content."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.md5(text.cast("binary")).alias("m"),
                        text.alias("text")).dropDuplicates(["d", "m"])
    named = mixed.draws.join(mixed.rows.select("row", "mark"), "row").join(
        texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return named.select("shard", "place", "doc_id", F.array_join(
        F.slice(words, F.col("first_word").cast("int") + 1, F.col("words").cast("int")), " ").alias("text"))
