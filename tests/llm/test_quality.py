"""The quantile sketches and the fences of the quality rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality


@pytest.mark.parametrize("kind", ["wide", "zeros", "ties"])
def test_sketched_quartiles_are_near_the_exact_ones(spark, kind):
    rng = np.random.default_rng(3)
    v = {"wide": np.exp(rng.normal(8, 3, 5000)), "zeros": np.where(rng.random(5000) < 0.9, 0, rng.integers(1, 9000, 5000)), "ties": rng.integers(0, 3, 5000)}[kind].astype(np.int64)
    rows = spark.createDataFrame([("f", int(x), k % 7) for k, x in enumerate(v)], "feature string, v long, source int")
    # Sketches of seven sources, merged.
    parts = rows.select("source", "feature", quality.sketch_step(F.col("v")).alias("step")).groupBy("source", "feature", "step").agg(F.count("*").alias("n"))
    got = quality.quartiles(parts, []).first()
    above = v[v > 0]
    assert (got["n"], got["some"]) == (len(v), len(above))
    for name, values, part in (("q1", v, 1), ("q3", v, 3), ("s1", above, 1), ("s3", above, 3)):
        exact = int(np.sort(values)[-(-part * len(values) // 4) - 1])
        assert exact * (1 - 2 ** (1 - quality.BITS)) <= got[name] <= exact


def test_a_step_keeps_its_highest_bits(spark):
    values = [0, 1, 255, 511, 512, 513, 1023, 1024, 10**6 + 7, 2**62 + 12345]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.sketch_step(F.col("v"))).collect()]
    assert got == [v >> max(0, v.bit_length() - 9) << max(0, v.bit_length() - 9) for v in values]


def sketch(spark, groups):
    """groups: (lang, source) to {feature: values}."""
    rows = [(g, s, f, int(v)) for (g, s), by in groups.items() for f, values in by.items() for v in values]
    df = spark.createDataFrame(rows, "lang string, source string, feature string, v long")
    return df.groupBy("lang", "source", "feature", quality.sketch_step(F.col("v")).alias("step")).agg(F.count("*").alias("n"))


def test_fences_follow_their_group_and_small_ones_their_language(spark):
    rng = np.random.default_rng(1)
    some = lambda n, at: {"word_length": rng.normal(at, 20, n).astype(int), "symbols": np.where(rng.random(n) < 0.9, 0, rng.integers(1, at, n)), "dup_lines": np.zeros(n, int), "repeats": np.zeros(n, int)}
    t = {(r["lang"], r["source"]): r for r in quality.fences(sketch(spark, {("x", "big"): some(20_000, 400), ("x", "other"): some(20_000, 600), ("x", "tiny"): some(3, 5000), ("y", None): some(20_000, 200)})).collect()}
    assert t["x", "big"]["word_length_hi"] < t["x", "other"]["word_length_lo"] + 250 and t["x", "big"]["word_length_hi"] < t["x", "other"]["word_length_hi"]
    assert 1100 < t["x", "tiny"]["word_length_hi"] < 1300  # nearly its language's, whose quartiles lie about 400 and 600
    assert t["y", None]["symbols_hi"] < t["x", "other"]["symbols_hi"] and t["y", None]["dup_lines_hi"] == 0


def test_a_group_changes_its_fences_smoothly(spark):
    big = {"word_length": [500] * 3000 + [520] * 3000}
    at = []
    for n in (190, 199, 200, 201, 210):
        rows = quality.fences(sketch(spark, {("x", "a"): big, ("x", "b"): {"word_length": [300] * n + [304] * n}})).collect()
        at.append(next(r["word_length_hi"] for r in rows if r["source"] == "b"))
    assert max(abs(a - b) for a, b in zip(at, at[1:], strict=False)) <= 12
