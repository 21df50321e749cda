"""Embeddings as text: a line a word, its numbers with ten decimals, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import formatted


def lines(weights: DataFrame, vector: str = "in_w", digits: int = 10) -> DataFrame:
    """value: a line a row; null where the word or its whole vector is."""
    return weights.select(F.concat("word", F.lit(" "), formatted(F.col(vector).cast("array<double>"), digits)).alias("value"))


def write_text(weights: DataFrame, path: str, vector: str = "in_w", single_file: bool = False) -> None:
    """Sorted by owner and word; an earlier result is replaced. One file only where asked for: it goes through one task."""
    ordered = weights.orderBy("owner", "word") if "owner" in weights.columns else weights.orderBy("word")
    out = lines(ordered, vector)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    return parts.select(F.col("p")[0].alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("in_w"))
