"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets integer features. Those of documents that pass the base rules go into
quantile sketches per language and source: counts of the values rounded down to BITS significant
bits. A sketch has at most 2^(BITS - 1) steps for each doubling of the values, merging is addition, so the
result doesn't depend on order or partitioning, and a quantile read from it is never above the exact
one and below it by less than 1 / 2^(BITS - 1) of it.

Thresholds come from the sketches alone. A fence lies beyond the quartiles of its group by three times their distance
(Tukey's outer fence) or by one and a half times the quartile distance of the values above zero (his inner
one), whichever is more: most documents have no symbols or repeats at all, so both quartiles of
these features are zero and what spread there is lies in the rest. Quartiles of small groups are
drawn towards those of their language, and these towards the corpus's, each by the weight of
``weight`` documents, so nothing jumps at some size of a group. Documents are filtered by a
join with their group's fences.

Defined results: null or empty text has no words and fails the base rules; null language or
source forms a group like any other; repeated rows are judged one by one; where no document of the corpus has a feature
above zero its fence is zero; an empty table gives no rows; extra columns are kept by keep_quality().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import let, write_table

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Groups whose fences are broadcast at most, about 20 MB; beyond, rows are joined by a shuffle and salted.
BROADCAST_GROUPS, SHARES = 100_000, 64
#: feature: numerator, denominator, units a whole, has a lower fence
FEATURES = {
    "word_length": ("word_chars", "n_words", 1000, True),
    "symbols": ("n_symbols", "word_chars", 10_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, False),
}
#: Significant bits of a step of the sketches.
BITS = 9


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of 8 words found twice or more. Hashes rule out most texts; the rest compare the windows themselves."""
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def exact(w: Column) -> Column:
        tagged = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))
        at = let(tagged, lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((F.get(s, k)["w"] == F.get(s, k - 1)["w"]) | (F.get(s, k)["w"] == F.get(s, k + 1)["w"]), F.get(s, k)["i"])), lambda i: i.isNotNull()))
        covered = F.aggregate(
            F.sort_array(at),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
        )
        return covered["n"]

    def some(w: Column) -> Column:
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w)).otherwise(0))

    return F.when(n > WINDOW, let(words, some)).otherwise(0)


def with_features(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.size(s["l"]).cast("long").alias("n_lines"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(s["w"], F.size(s["w"])).cast("long").alias("n_repeat_words"),
        ),
    )
    bare = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    out = docs.withColumns({"_f": facts, "word_chars": bare.cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    out = out.select(*[c for c in out.columns if c != "_f"], "_f.*")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _value(name: str) -> Column:
    top, bottom, units, _ = FEATURES[name]
    return F.coalesce(F.expr(f"({units} * {top}) div nullif({bottom}, 0)"), F.lit(0)).cast("long")


def sketch_step(value: Column) -> Column:
    """A value, not negative, rounded down to BITS significant bits."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(features: DataFrame) -> DataFrame:
    """lang, source, feature, step, n: the sketch of each group, from documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("feature"), sketch_step(_value(k)).alias("step")) for k in FEATURES])
    rows = features.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("x"))
    return rows.groupBy("lang", "source", "x.feature", "x.step").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1, q3 of all values, and some, s1, s3 of those above zero, of every group of keys and feature, merged from finer sketches."""
    merged = sketch.groupBy(*keys, "feature", "step").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys, "feature")
    zeros = F.sum(F.when(F.col("step") == 0, F.col("n")).otherwise(0))
    ranked = merged.withColumns({"below": F.sum("n").over(whole.orderBy("step")), "size": F.sum("n").over(whole), "zeros": zeros.over(whole)})
    some, above = F.col("size") - F.col("zeros"), F.col("below") - F.col("zeros")
    least = lambda ok: F.min(F.when(ok, F.col("step")))
    return ranked.groupBy(*keys, "feature").agg(
        F.max("size").alias("n"),
        F.max(some).alias("some"),
        least(F.col("below") * 4 >= F.col("size")).alias("q1"),
        least(F.col("below") * 4 >= 3 * F.col("size")).alias("q3"),
        F.coalesce(least((F.col("step") > 0) & (above * 4 >= some)), F.lit(0)).alias("s1"),
        F.coalesce(least((F.col("step") > 0) & (above * 4 >= 3 * some)), F.lit(0)).alias("s3"),
    )


def _drawn(own: str, to: str, weight: int) -> list[Column]:
    """Quartiles of the rows ``own``, drawn towards those of ``to`` by the weight of ``weight`` documents."""
    return [F.expr(f"({own}.{n} * {own}.{q} + {weight} * {to}.{q}) div ({own}.{n} + {weight})").alias(q) for n, qs in (("n", ("q1", "q3")), ("some", ("s1", "s3"))) for q in qs]


def fences(sketch: DataFrame, weight: int = 200) -> DataFrame:
    """lang, source and the fences that hold for them."""
    own, by_lang, whole = (quartiles(sketch, keys).alias(name) for keys, name in ((["lang", "source"], "a"), (["lang"], "b"), ([], "c")))
    langs = by_lang.join(F.broadcast(whole), F.expr("b.feature = c.feature")).select("b.lang", "b.feature", *_drawn("b", "c", weight))  # a row a feature
    rows = own.join(langs.alias("l"), F.expr("a.feature = l.feature and a.lang <=> l.lang")).select("a.lang", "a.source", "a.feature", *_drawn("a", "l", weight))
    spread = F.greatest(3 * (F.col("q3") - F.col("q1")), F.expr("3 * (s3 - s1) div 2"))
    cols = []
    for k, (*_, low) in FEATURES.items():
        own = F.col("feature") == k
        cols.append(F.max(F.when(own, F.col("q3") + spread)).alias(f"{k}_hi"))
        if low:
            cols.append(F.max(F.when(own, F.col("q1") - spread)).alias(f"{k}_lo"))
    return rows.groupBy("lang", "source").agg(*cols)


def _marked(docs: DataFrame, keep: list[str], weight: int) -> DataFrame:
    """Columns ``keep`` as k0, k1, ..., the features, base_failed and kept.

    The features are written once to the shared folder with what is kept of the documents; the sketches and the join read them there.
    """
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text", "lang", "source")
    features = write_table(with_features(rows).drop("text"), "features")
    limits = write_table(fences(sketches(features), weight), "fences")
    if limits.count() <= BROADCAST_GROUPS:
        marked = features.alias("f").join(F.broadcast(limits).alias("t"), F.expr("f.lang <=> t.lang and f.source <=> t.source"), "left")
    else:  # a source may hold a third of all rows: each group's rows go to SHARES keys
        shares = limits.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        rows = features.withColumn("share", F.pmod(F.xxhash64("k0", "n_words", "word_chars"), F.lit(SHARES)).cast("int"))
        marked = rows.alias("f").join(shares.alias("t"), F.expr("f.lang <=> t.lang and f.source <=> t.source and f.share = t.share"), "left")
    sides = [_value(k) <= F.col(f"{k}_hi") for k in FEATURES] + [_value(k) >= F.col(f"{k}_lo") for k, f in FEATURES.items() if f[-1]]
    inside = F.coalesce(reduce(lambda a, b: a & b, sides), F.lit(True))
    return marked.withColumn("kept", ~F.col("base_failed") & inside)


def quality(docs: DataFrame, weight: int = 200) -> DataFrame:
    """doc_id, features, base_failed and kept of every document."""
    out = _marked(docs, ["doc_id"], weight)
    return out.select(F.col("k0").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_quality(docs: DataFrame, weight: int = 200) -> DataFrame:
    """The documents, with all their columns, that quality() keeps."""
    out = _marked(docs, docs.columns, weight).where("kept")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
