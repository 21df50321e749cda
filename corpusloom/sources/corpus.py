"""Corpora: text files and tables, and explicit partitions of them."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import DELIMITERS, SPACE, byte_count

RANGE = 1 << 16


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A text file as (doc_id, text), a row a line. Ids grow with the file's order; a split never cuts a line, so never a word."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def running_total(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``key``, which must be unique integers.

    Rows are summed within ranges of 65,536 keys, and only the ranges' totals are summed in one place.
    """
    parts = df.withColumn("_range", F.floor(F.col(key) / RANGE)).withColumn("_value", value)
    inside = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = parts.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(before, "_range")
    return out.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_range", "_value", "_inside", "_before")


def balanced_partitions(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, part, read_offset, read_length: documents in order, cut into ``parts`` runs of about equal bytes; a document is never cut."""
    placed = running_total(docs, "doc_id", F.coalesce(byte_count(F.col("text")), F.lit(0)), "read_offset")
    size = docs.agg(F.greatest(F.lit(1), F.ceil(F.sum(byte_count(F.col("text"))) / parts)).cast("long").alias("size"))
    return placed.join(F.broadcast(size)).select(
        "doc_id",
        F.least(F.floor(F.col("read_offset") / F.col("size")), F.lit(parts - 1)).cast("int").alias("part"),
        "read_offset",
        F.coalesce(byte_count(F.col("text")), F.lit(0)).alias("read_length"),
    )


def _ranges(f: BinaryIO, size: int, parts: int) -> list[tuple[int, int]]:
    at, out = 0, []
    for k in range(parts):
        end = size if k == parts - 1 else min(size, at + size // parts)
        while end < size:
            f.seek(end)
            piece = f.read(4096)
            found = [i for i in (piece.find(bytes([d])) for d in DELIMITERS) if i >= 0]
            if found:
                end += min(found)
                break
            end += len(piece)
        out.append((at, end - at))
        at = end
    return out


def byte_ranges(path: str, parts: int) -> list[tuple[int, int]]:
    """(offset, length) of each part of a local file: about size / parts bytes, up to the next delimiter, which begins the next part.

    The last part takes all that is left. Spark's own splits replace this in jobs; it is for tools that address files by bytes.
    """
    with open(path, "rb") as f:
        return _ranges(f, os.path.getsize(path), parts)


def text_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, part, read_offset, read_length: byte_ranges() of every text by itself. Null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode()
                rows += [(doc, k, *r) for k, r in enumerate(_ranges(io.BytesIO(data), len(data), parts) if text is not None else ())]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "part", "read_offset", "read_length"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, part int, read_offset long, read_length long")


def chunks(path: str, offset: int, length: int, size: int = 150_000) -> Iterator[bytes]:
    """The bytes of a part, a chunk at a time."""
    with open(path, "rb") as f:
        f.seek(offset)
        while length > 0 and (piece := f.read(min(size, length))):
            length -= len(piece)
            yield piece


def whole_words(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of consecutive chunks, cut before the last delimiter of each so that no word or character is torn."""
    rest = b""
    for piece in pieces:
        data = rest + piece
        cut = max(data.rfind(bytes([d])) for d in DELIMITERS)
        if cut > 0:
            yield data[:cut].decode("utf-8", "replace")
            data = data[cut:]
        rest = data
    if rest:
        yield rest.decode("utf-8", "replace")


def reassembled(docs: DataFrame, size: int = 1000) -> DataFrame:
    """doc_id, piece, text: every text sent in chunks of ``size`` bytes and put together again as pieces of whole words. Null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode()
                rows += [(doc, k, t) for k, t in enumerate(whole_words(data[i : i + size] for i in range(0, len(data), size)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.string()], strict=True)], ["doc_id", "piece", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, text string")


class WordReader:
    """The words of a part of a local file, a chunk at a time; it tells how far it is and may begin anew."""

    def __init__(self, path: str, offset: int = 0, length: int | None = None, size: int = 30_000) -> None:
        self.path, self.offset, self.size = path, offset, size
        self.length = os.path.getsize(path) - offset if length is None else length
        self.reset()

    def reset(self) -> None:
        self._read = 0
        self._words = self._all()

    def progress(self) -> float:
        """The part of the bytes that has been read, 1 at the end."""
        return self._read / self.length if self.length else 1.0

    def _counted(self) -> Iterator[bytes]:
        for piece in chunks(self.path, self.offset, self.length, self.size):
            self._read += len(piece)
            yield piece

    def _all(self) -> Iterator[str]:
        for text in whole_words(self._counted()):
            yield from (w for w in re.split(SPACE, text.lower()) if w)

    def __iter__(self) -> WordReader:
        return self

    def __next__(self) -> str:
        return next(self._words)
