"""Pattern spans with code-point positions, in built-in SQL functions.

``regexp_extract_all`` gives the matches and ``split`` the text between them;
running lengths of both give each match's place.  ``length`` counts code
points, so the positions do too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 512
SPAN = "struct<start:int,end:int,kind:string,value:string>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find(text: Column, pattern: str, kind: str, group: int = 0,
         ok: Callable[[Column], Column] | None = None, view: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (Java syntax, never
    empty) as an array of ``SPAN``; ``value`` is the group's text.  A match
    whose value fails ``ok`` is dropped, and its text stays consumed.  With
    ``view`` each span also has ``before``, the code points before it, as many
    as that at most.

    Work grows with the text and its matches, not with their product: places
    are added up within runs of ``RUN`` matches, and the runs' lengths once
    more, so no array that grows by single entries is longer than a run.
    """
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    fields = SPAN[:-1] + ",before:string>" if view else SPAN
    nothing = F.expr(f"cast(array() as array<{fields}>)")

    def last(part: Column) -> Column:
        return F.right(part, F.lit(view)) if view else F.lit("")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        before = last(F.concat(acc["tail"], x["gap"])) if view else F.lit("")
        more = [before.alias("before")] if view else []
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), *more)
        good = x["hit"].isNotNull() if ok is None else x["hit"].isNotNull() & ok(x["value"])
        tail = last(F.concat(before, F.coalesce(x["hit"], F.lit("")))) if view else F.lit("")
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"), tail.alias("tail"))

    def runs(r: Column) -> Column:
        def one(k: Column) -> Column:
            first = k * RUN
            tail = F.lit("")
            if view:                 # matches are not empty, so as many rows as code points reach back far enough
                back = F.least(first, F.lit(view))
                tail = last(F.array_join(F.transform(F.slice(r, first - back + 1, back), lambda x: F.concat(
                    x["gap"], F.coalesce(x["hit"], F.lit("")))), ""))
            zero = F.struct(F.lit(0).alias("at"), nothing.alias("out"), tail.alias("tail"))
            return F.aggregate(F.slice(r, first + 1, F.lit(RUN)), zero, step, lambda acc: F.struct(acc["at"], acc["out"]))

        return F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(r) - 1, F.lit(RUN)).cast("int")), one)

    def placed(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(parts, zero, lambda acc, p: F.struct(
            (acc["at"] + p["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"])
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["out"], lambda x: x.withField(
            "start", x["start"] + s).withField("end", x["end"] + s))))

    return bind(rows, lambda r: bind(runs(r), placed))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(spans: Column, kinds: list[str], by_kind_first: bool) -> Column:
    """Spans by start then kind (as listed), or by kind then start."""
    place = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        kind = F.array_position(place, s["kind"])
        first, second = (kind, s["start"]) if by_kind_first else (s["start"], kind)
        return F.struct(first.cast("long").alias("a"), second.cast("long").alias("b"), s["end"].alias("c"),
                        s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["s"])
