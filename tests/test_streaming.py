"""Streaming ingest: files arriving in two waves land once each, and the
batch de-duplication over the appended table sees all of them."""

from __future__ import annotations

import tempfile

import pytest

from riskbook.operators import quality
from riskbook.sources.book import Book
from riskbook.streaming.ingest import append_files

HEADER = ("TransactionID,AccountOriginID,AccountDestinationID,TransactionTypeID,Amount,"
          "TransactionDate,BranchID,Description\n")


def _drop(folder, name, rows):
    with open(f"{folder}/{name}.csv", "w") as f:
        f.write(HEADER + "".join(rows))


def test_append_waves_then_dedupe(spark):
    src = tempfile.mkdtemp(prefix="rb-src-")
    dst = tempfile.mkdtemp(prefix="rb-dst-")
    ckpt = tempfile.mkdtemp(prefix="rb-ckpt-")
    _drop(src, "a", ["1,10,11,1,5.00,2024-01-02 00:00:00,1,x\n", "1,10,11,1,7.00,2024-01-01 00:00:00,1,y\n"])
    append_files(spark, "transactions", src, dst, checkpoint=ckpt).awaitTermination(120)
    _drop(src, "b", ["2,20,21,2,3.50,2024-02-01 10:30:00,2,z\n"])
    append_files(spark, "transactions", src, dst, checkpoint=ckpt).awaitTermination(120)
    # a third run with nothing new adds nothing
    append_files(spark, "transactions", src, dst, checkpoint=ckpt).awaitTermination(120)

    tx = spark.read.parquet(dst)
    assert tx.count() == 3
    book = Book.from_frames(spark, transactions=tx)
    got = {r["TransactionID"]: str(r["Amount"]) for r in quality.dedupe_transactions(book).collect()}
    assert got == {1: "7.00", 2: "3.50"}


def test_malformed_file_stops_the_stream(spark):
    src = tempfile.mkdtemp(prefix="rb-src-")
    dst = tempfile.mkdtemp(prefix="rb-dst-")
    ckpt = tempfile.mkdtemp(prefix="rb-ckpt-")
    _drop(src, "bad", ["not-a-number,10,11,1,5.00,2024-01-02 00:00:00,1,x\n"])
    q = append_files(spark, "transactions", src, dst, checkpoint=ckpt)
    with pytest.raises(Exception):
        q.awaitTermination(120)
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    assert spark.read.schema("TransactionID long").parquet(dst).count() == 0
