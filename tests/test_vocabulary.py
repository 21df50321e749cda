"""Subsampling, indices, pairs and sampling on hand-made inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import EmbeddingConfig
from corpusloom.operators import counts, sampling, skipgrams, vocabulary
from corpusloom.storage import materialise


def test_keep_probability(spark):
    df = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 9, 100)], "c long")
    got = [r[0] for r in df.select(F.round(vocabulary.keep_probability(F.col("c"), F.lit(1.0)), 6)).collect()]
    assert got == [1, 1, 0.910684, 0.75, 0.444444, 0.11]


def test_types_below_min_count_go_and_empty_owners_stay(spark):
    c = EmbeddingConfig(owners=7, min_count=2, sample=1e9)
    rows = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "word string, cnt long")
    kept = vocabulary.subsample(rows, c).where("kept")
    assert {r["word"] for r in kept.collect()} == {"a", "c"}
    parts = vocabulary.partitions(kept, 7).orderBy("owner").collect()
    assert len(parts) == 7 and sum(p["length"] for p in parts) == 2
    assert sorted(r["global_idx"] for r in vocabulary.global_index(kept.select("word", "cnt", "owner"), 7).collect()) == [0, 1]


def test_global_threshold(spark):
    rows = spark.createDataFrame([(w, 10) for w in "abcdef"], "word string, cnt long")
    got = {r["threshold"] for r in vocabulary.thresholds(rows, EmbeddingConfig(owners=3, threshold_scope="global")).collect()}
    assert got == {60 * 1e-3}


def _vocab(spark, words):
    return spark.createDataFrame([(w, 1, 0, i, i) for i, w in enumerate(words)], "word string, cnt long, owner int, local_idx int, global_idx long")


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize(("window", "want"), [(1, {"a": ["b"], "b": ["a"]}), (2, {"a": ["b"], "b": ["a", "c"], "c": ["b"]})])
def test_words_outside_the_vocabulary_keep_their_place(spark, window, want, most):
    docs, vocab = spark.createDataFrame([(1, "a b x c")], "doc_id long, text string"), _vocab(spark, "abc")
    rows = skipgrams.with_words(skipgrams.document_pairs(docs, vocab, window, most), vocab).groupBy("center").agg(F.sort_array(F.collect_list("ctx")).alias("inputs")).collect()
    assert {r["center"]: r["inputs"] for r in rows} == want


def test_pairs_across_batches_are_those_of_one(spark):
    """Tokens are sent on in batches; a document that begins in one and ends in another loses no pair, and repeated doc_ids stay apart."""
    rng = np.random.default_rng(6)
    texts = [(k // 2, " ".join(rng.choice(list("abcdx"), int(rng.integers(0, 30))))) for k in range(40)]
    docs, vocab = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), _vocab(spark, "abcd")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for doc, text in texts:
        w = text.split(" ")
        want.update((doc, w[i], w[j]) for i in range(len(w)) for j in range(max(0, i - 3), min(len(w), i + 4)) if i != j and not {"x", ""} & {w[i], w[j]})
    try:
        for rows in (1, 2, 7, 10_000):
            spark.conf.set(key, rows)
            got = skipgrams.with_words(skipgrams.document_pairs(docs, vocab, 3), vocab).collect()
            assert Counter((r["doc_id"], r["center"], r["ctx"]) for r in got) == want
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("most", [None, 0])
def test_corpus_scope_crosses_short_documents(spark, most):
    texts = ["a b", "", "c", "x", "d a", "b c d a b"]
    docs, vocab = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), _vocab(spark, "abcd")
    flat = " ".join(t for t in texts if t).split(" ")
    for w in (1, 2, 3, 4):
        want = Counter((flat[i], flat[j]) for i in range(len(flat)) for j in range(max(0, i - w), min(len(flat), i + w + 1)) if i != j and "x" not in (flat[i], flat[j]))
        got = Counter((r["center"], r["ctx"]) for r in skipgrams.with_words(skipgrams.pairs(docs, vocab, w, "corpus", most), vocab).collect())
        assert got == want


@pytest.mark.parametrize("word", ["hot", "out"])
def test_a_word_in_a_third_of_all_tokens_is_not_shuffled_by(spark, word):
    """Beyond the broadcast bound, whether the frequent word is in the vocabulary or not."""
    n = 3000
    docs = spark.range(n, numPartitions=4).selectExpr("id AS doc_id", f"concat('{word} w', id % 700, ' x', id) AS text")
    vocab = materialise(_vocab(spark, ["hot", *(f"w{k}" for k in range(500))]), "vocab")
    known = {r["word"] for r in vocab.collect()}
    tokens = counts.tokens(docs)
    want = Counter(w for d in docs.collect() for w in d["text"].split(" "))
    inside = vocabulary.in_vocabulary(tokens, vocab, most=10)
    assert Counter(r["word"] for r in inside.collect()) == {w: k for w, k in want.items() if w in known}
    assert Counter(r["word"] for r in vocabulary.out_of_vocabulary(tokens, vocab, most=10).collect()) == {w: k for w, k in want.items() if w not in known}
    rows = skipgrams.encode(docs, vocab, most=10)
    assert rows.count() == sum(k for w, k in want.items() if w in known)
    # The rows that a shuffle by word deals out hold the frequent word no more.
    shuffled = tokens.join(F.broadcast(tokens.groupBy("word").count().where(F.col("count") * vocabulary.SHARES > 3 * n).select("word")), "word", "left_anti")
    assert shuffled.where(F.col("word") == word).count() == 0 and shuffled.groupBy("word").count().agg(F.max("count")).first()[0] <= 3 * n / vocabulary.SHARES


def test_the_vocabulary_reads_the_corpus_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "a b c a") for k in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, plans, store = spark.read.parquet(str(tmp_path / "docs")), [], vocabulary.materialise

    def stored(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(vocabulary, "materialise", stored)
    out = vocabulary.vocabulary(docs, EmbeddingConfig(owners=3, sample=1e9))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert {r["word"] for r in out.collect()} == {"a", "b", "c"}
    assert sum("text#" in p for p in plans) == 1


@pytest.mark.parametrize(
    ("numbers", "s", "alias"),
    [
        ([10, 5, 3, 2], [1.0, 1.0, 0.6, 0.4], [0, 1, 0, 0]),
        ([7, 1, 1, 1, 3, 9], [0.454545, 0.272727, 0.272727, 0.272727, 0.818182, 1.0], [5, 0, 5, 0, 5, 5]),
    ],
)
def test_alias_table(numbers, s, alias):
    got_s, got_alias = sampling.alias_table(np.array(numbers, float))
    assert np.allclose(got_s, s, atol=1e-6) and got_alias.tolist() == alias


def test_alias_mass_of_random_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100):
        c = rng.integers(1, 1000, n).astype(float)
        s, a = sampling.alias_table(c)
        mass = s.copy()
        np.add.at(mass, a[a != np.arange(n)], (1 - s)[a != np.arange(n)])
        assert np.allclose(mass / n, c / c.sum())


def test_negatives_of_a_tiny_owner():
    s = sampling.NegativeSampler(np.array([1000.0, 1.0, 1.0]), np.random.default_rng(0))
    drawn, valid = s.sample(np.array([[0, -1]] * 20), 5)
    assert (valid.sum(1) == 2).all()
    assert all(set(d[v]) == {1, 2} for d, v in zip(drawn, valid, strict=True))


@pytest.mark.parametrize("name", ["counted_pairs", "joined_inputs"])
def test_words_near_a_place_without_a_shuffle(spark, name):
    """Batches of any size, ids that repeat, a large vocabulary: all the same; and pairs aren't shuffled where ids don't repeat."""
    from corpusloom.storage import materialise

    rng = np.random.default_rng(6)
    words = np.array(["a", "B", "é", "z", "c", "ab", "😀", "\uffff", *(f"x{k}" for k in range(20))])
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, "a"), (103, "a b"), (104, "a a a a")], "doc_id long, text string").repartition(3)
    vocab = [(w, k, k % 2) for k, w in enumerate(words) if k != 9]
    vocab = materialise(spark.createDataFrame(vocab, "word string, global_idx long, owner int"), "vocabulary")
    f = lambda d, **more: getattr(skipgrams, name)(d, vocab, 3, **more)
    rows = lambda t: sorted(map(repr, t.collect()))
    twice = docs.unionByName(docs.where("doc_id % 7 = 0"))
    try:
        for d, want in ((docs, rows(f(docs, most=3))), (twice, rows(f(twice, repeated=0)))):
            assert len(want) > 500
            for size in (1, 2, 5, 10_000):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
                assert rows(f(d)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = f(docs.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_negatives_of_a_pair_are_its_own_and_pairs_are_shuffled_once(spark):
    """However pairs come, by broadcast counts or by owners' tasks, a pair's negatives are the same; they follow the counts; a pair of a small owner is kept, without any."""
    from corpusloom.storage import materialise

    words = [(k, 0, k, 1000 if k < 5 else 10) for k in range(50)] + [(50, 1, 0, 7)]
    vocab = materialise(spark.createDataFrame(words, "global_idx long, owner int, local_idx int, cnt long"), "vocabulary")
    rows = [(0, a, b) for a in range(50) for b in range(51)] * 2 + [(1, 50, 3)]
    pairs = spark.createDataFrame(rows, "owner int, out_idx long, in_idx long")
    got = [{(r["out_idx"], r["in_idx"]): tuple(r["negatives"]) for r in sampling.negatives(pairs.repartition(k), vocab, 3, seed, most).collect()} for k, seed, most in ((1, 1, None), (7, 1, None), (3, 1, 5), (1, 2, None))]
    assert got[0] == got[1] == got[2] != got[3]
    assert len(got[0]) == 50 * 51 + 1 and got[0].pop((50, 3)) == ()
    assert all(len(set(v)) == 3 and not {*pair} & {*v} for pair, v in got[0].items())
    drawn = np.bincount(np.concatenate([v for v in got[0].values()]), minlength=50)
    assert drawn[:5].min() > 10 * drawn[5:].max() / 2 and drawn.min() > 0
    plan = sampling.negatives(pairs, vocab, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("size", "tokens", "held"), [(1, 1, 4), (2, 5, 3), (7, 1000, 5), (1000, 10**6, 100), (10**6, 10**9, 1000)])
def test_packed_pairs_come_back_distinct(size, tokens, held):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    codes = sampling._Codes(size, tokens, held)
    a, b = rng.integers(0, size, 2000), rng.integers(0, size, 2000)
    a[:2], b[:2] = (0, size - 1), (size - 1, 0)
    batches = [pa.RecordBatch.from_pydict({"out_idx": a[i : i + 64], "in_idx": b[i : i + 64]}) for i in range(0, 2000, 64)]
    packed = pa.Table.from_batches(list(codes.pack(iter(batches)))).sort_by("bucket")
    got = [(x, y) for p in codes.distinct(iter(packed.to_batches(max_chunksize=3)), rows=11) for x, y in zip(*(v.tolist() for v in p), strict=True)]
    assert len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("name", ["joined_inputs", "counted_pairs"])
def test_words_near_a_place_with_a_large_vocabulary(spark, name, monkeypatch):
    """In parts of any number the results are those of a plain loop, and neither tokens nor pairs are shuffled: only texts by part, and words of parts."""
    from corpusloom.storage import materialise

    rng = np.random.default_rng(7)
    words = ["a", "B", "é", "z", "ab", "😀", "￿", *(f"x{k}" for k in range(20))]
    ids = [*range(20), -1, -(2**62), 2**62, *range(5000, 60_000, 3000)]
    texts = {d: " ".join(rng.choice(words, int(rng.integers(0, 40)))) for d in ids} | {97: None, 98: "", 99: "x1"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    known = {w.lower() for w in words if w not in ("x3", "x4", "a")}
    vocab = materialise(spark.createDataFrame([(w, k, k % 2) for k, w in enumerate(sorted(known))], "word string, global_idx long, owner int"), "vocabulary")
    near: dict[tuple, Counter] = {}
    for d, text in texts.items():
        flat = [w for w in (text or "").lower().split(" ") if w]
        for i, w in enumerate(flat):
            around = [flat[j] for j in range(max(0, i - 3), min(len(flat), i + 4)) if j != i and flat[j] in known]
            if w in known and around:
                near[d, i, w] = Counter(around)
    if name == "joined_inputs":
        want = Counter((*k, " ".join(sorted(v.elements(), key=str.encode))) for k, v in near.items())
    else:
        want = Counter((*k, w, n) for k, v in near.items() for w, n in v.items())
    for size in (1 << 24, 60):
        monkeypatch.setattr(skipgrams, "PART_BYTES", size, raising=False)
        got = getattr(skipgrams, name)(docs, vocab, 3, most=0)
        assert Counter(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pos" not in " ".join(x for x in plan.split("\n") if "Aggregate" in x or "RepartitionBy" in x) and plan.count("Join") == 1 + plan.count("LeftAnti")
