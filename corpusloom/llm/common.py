"""Helpers shared by the training-data operators: storage, batches and hot-key joins."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import discard as drop
from corpusloom.storage import materialise as write_table
from corpusloom.storage import new_path

__all__ = ["drop", "free_shuffles", "join_hot", "let", "new_path", "read", "short_batches", "short_reads", "write_table"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on at most ``rows`` texts, and about ``size`` bytes, go to Python at once in this session: a batch is held on both sides, and the JVM keeps what its largest took."""
    for key, most, default in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, "64m")):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, default))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def short_reads(spark: SparkSession, rows: int = 256) -> None:
    """From now on at most ``rows`` rows are read from Parquet at once in this session: the JVM holds a batch's texts in one array, which takes whole regions of its heap."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > rows:
        spark.conf.set(key, str(rows))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # Python's references first, then what they held in the JVM; the cleaner follows by itself
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def join_hot(big: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner", shares: int = 1000) -> DataFrame:
    """Equi-join of ``big`` with ``small``, one row a key, whose column ``n`` counts the key's rows in ``big``.

    A key with more than ``total / shares`` rows is hot. There are at most ``shares`` of
    those whatever the input is, so these rows of ``small`` are broadcast and their share of
    ``big`` isn't shuffled; all other keys are joined by a shuffle.
    """
    hot = small.where(F.col(n) * shares > total)
    keys = hot.select(key)
    cold_big = big.join(F.broadcast(keys), key, "left_anti")
    parts = cold_big.join(small.where(F.col(n) * shares <= total), key, how)
    return parts.unionByName(big.join(F.broadcast(hot), key, "inner"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
