"""Small tables for the training-data tests."""

from __future__ import annotations

from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                       T.StructField("spans", T.StringType()), T.StructField("row", T.StringType()),
                       T.StructField("fp", T.StringType())])


def table(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose
    names operators use themselves."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None, "s", "p", "r", "f") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """NULLs, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} and {i}" for i in range(30_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (None, "some words without an id", "en", "b"),
            (4, long, "en", "a"), (4, long, "en", "a"), (5, "one", None, "b"), (6, "😀 é x ñ", "es", None),
            (None, None, None, None), (7, "x" * 60_000, "en", "a")]
