"""Tokens and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import owner, tokenise


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word; made within a row, without a shuffle."""
    return docs.select("doc_id", F.posexplode(tokenise(F.col("text"))).alias("pos", "word"))


def doc_token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokenise(F.col("text"))).cast("long").alias("n_tokens"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, cnt over the corpus. Each task sums first, so a word that is in every document shuffles as a row a task."""
    words = docs.select(F.explode(tokenise(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several corpus parts as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def owned(counts: DataFrame, owners: int) -> DataFrame:
    return counts.withColumn("owner", owner(F.col("word"), owners))
