"""The vocabulary: which word types stay, who owns them, and their numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import EmbeddingConfig
from corpusloom.functions.text import unit_random
from corpusloom.operators.counts import owned, word_counts
from corpusloom.storage import materialise

#: Words of a vocabulary that is broadcast at most: about 200 MB in a task's hash table.
BROADCAST_WORDS = 1_000_000
#: Beyond that, words with more than this part of all tokens aren't shuffled by.
SHARES = 1000


def keep_probability(cnt: Column, threshold: Column) -> Column:
    """1 for rare words; falls with the share of a word in its owner's tokens."""
    return F.least(F.lit(1.0), (F.sqrt(cnt / threshold) + 1) * (threshold / cnt))


def thresholds(counts: DataFrame, c: EmbeddingConfig) -> DataFrame:
    """counts with owner and threshold: ``sample`` of the retained tokens of the owner (or of all)."""
    retained = F.sum(F.when(F.col("cnt") >= c.min_count, F.col("cnt")))
    rows = owned(counts, c.owners)
    keys = ["owner"] if c.threshold_scope == "owner" else []
    sums = rows.groupBy(*keys).agg((F.coalesce(retained, F.lit(0)).cast("double") * F.lit(c.sample)).alias("threshold"))
    return rows.join(F.broadcast(sums), keys) if keys else rows.join(F.broadcast(sums))  # a row an owner


def subsample(counts: DataFrame, c: EmbeddingConfig, keep: Callable[[Column, Column], Column] = keep_probability) -> DataFrame:
    """counts with owner, threshold, p and kept. A dropped type is dropped everywhere; ``keep`` is the strategy."""
    rows = thresholds(counts, c)
    enough = F.col("cnt") >= c.min_count
    rows = rows.withColumn("p", F.when(enough, keep(F.col("cnt"), F.col("threshold"))).otherwise(F.lit(0.0)))
    return rows.withColumn("kept", enough & (F.col("p") > unit_random(F.col("word"), c.seed)))


def retention(subsampled: DataFrame) -> DataFrame:
    return subsampled.groupBy("owner").agg(F.count("*").alias("n_types"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"))


def local_index(kept: DataFrame) -> DataFrame:
    """local_idx: the word's rank among its owner's, in byte order. A window an owner, so take more owners for more words."""
    return kept.withColumn("local_idx", (F.row_number().over(W.partitionBy("owner").orderBy("word")) - 1).cast("int"))


def partitions(kept: DataFrame, owners: int) -> DataFrame:
    """owner, length, first_word_index: one row an owner, empty ones too; summed in one place."""
    every = kept.sparkSession.range(owners).select(F.col("id").cast("int").alias("owner"))
    sizes = every.join(kept.groupBy("owner").agg(F.count("*").alias("length")), "owner", "left").select("owner", F.coalesce("length", F.lit(0)).alias("length"))
    before = F.sum("length").over(W.orderBy("owner").rowsBetween(W.unboundedPreceding, -1))
    return sizes.withColumn("first_word_index", F.coalesce(before, F.lit(0)))


def global_index(kept: DataFrame, owners: int) -> DataFrame:
    """word, cnt, owner, local_idx, global_idx."""
    first = partitions(kept, owners).select("owner", "first_word_index")
    rows = local_index(kept).join(F.broadcast(first), "owner")
    return rows.select("word", "cnt", "owner", "local_idx", to_global(F.col("local_idx"), F.col("first_word_index")).alias("global_idx"))


def to_global(local: Column, first: Column) -> Column:
    return (local + first).cast("long")


def to_local(global_: Column, first: Column) -> Column:
    return (global_ - first).cast("int")


def vocabulary(docs: DataFrame, c: EmbeddingConfig) -> DataFrame:
    """From texts to numbered words. The corpus is read once: its counts are stored, and all that follows reads these."""
    counts = materialise(word_counts(docs), "counts")
    kept = materialise(subsample(counts, c).where("kept").select("word", "cnt", "owner"), "kept")
    return global_index(kept, c.owners)


def small(vocab: DataFrame, most: int | None = None) -> bool:
    """Whether ``vocab`` may be broadcast. Counts it, so give a stored one."""
    most = BROADCAST_WORDS if most is None else most
    return vocab.limit(most + 1).count() <= most


def look_up(tokens: DataFrame, vocab: DataFrame, how: str = "inner", most: int | None = None) -> DataFrame:
    """Tokens joined with ``vocab`` by word.

    A vocabulary of at most ``most`` words is broadcast. Beyond, tokens are shuffled by word, but for those of frequent words: a word with more
    than a SHARES-th of all tokens, in the vocabulary or not, has its row (or its lack of one) sent to the tokens. There
    are at most SHARES of them, and no task gets a larger share of the rest.
    """
    if small(vocab, most):
        return tokens.join(F.broadcast(vocab), "word", how)
    n = materialise(tokens.groupBy("word").agg(F.count("*").alias("n")), "token-counts")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = n.where(F.col("n") * SHARES > total).select("word")
    rare = tokens.join(F.broadcast(frequent), "word", "left_anti").join(vocab, "word", how)
    common = tokens.join(F.broadcast(frequent), "word", "left_semi").join(F.broadcast(vocab.join(F.broadcast(frequent), "word", "left_semi")), "word", how)
    return rare.unionByName(common)


def in_vocabulary(tokens: DataFrame, vocab: DataFrame, most: int | None = None) -> DataFrame:
    return look_up(tokens, vocab.select("word"), "left_semi", most)


def out_of_vocabulary(tokens: DataFrame, vocab: DataFrame, most: int | None = None) -> DataFrame:
    return look_up(tokens, vocab.select("word"), "left_anti", most)
