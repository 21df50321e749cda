"""Large groups of near copies and a passage that hundreds of documents share."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import near


def test_a_leader_of_many_pairs_is_split(spark):
    rows = [(bytearray(b"a"), bytearray(b"%03d" % k)) for k in range(50)] + [(bytearray(b"b"), bytearray(b"001"))]
    sets = [(bytearray(b"a"), list(range(20))), (bytearray(b"b"), [1])] + [(bytearray(b"%03d" % k), list(range(k, 20 + k))) for k in range(50)]
    args = spark.createDataFrame(rows, "a binary, b binary"), spark.createDataFrame(sets, "cls binary, shingles array<long>")
    for most in (1000, 7):
        assert sorted(bytes(r["b"]) for r in near._confirm(*args, most=most).collect()) == [b"000", b"001", b"002"]


@pytest.mark.parametrize("branch", [256, 2])
def test_large_groups_lose_no_link(spark, branch):
    rng = np.random.default_rng(11)
    words = np.array([f"w{k}" for k in range(5000)])
    first, passage = rng.choice(words, 120), rng.choice(words, 60)
    rows = []
    for k in range(260):  # copies of one document with a few words changed, some too many
        t = first.copy()
        t[rng.choice(120, int(rng.integers(0, 7)), replace=False)] = rng.choice(words, 1)
        rows.append(" ".join(t))
    for k in range(260):  # a common passage and words of their own, about as similar as a link must be
        rows.append(" ".join([*passage, *rng.choice(words, int(rng.integers(4, 30)))]))
    table = list(enumerate(rows))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = [tuple(r) for r in near.near_components(docs, leaf=8, block=32, branch=branch).collect()]
    assert sorted(got) == sorted(brute.near_components(table))


def test_a_pair_in_a_branched_node_still_meets(spark):
    """A node of 600 classes without links but 60 pairs of similarity 0.75: nearly all meet in a small child of the node."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        mins = rng.integers(0, 2**32, near.HASHES, dtype=np.uint32)
        mins[rng.random(near.HASHES) < 0.3] = 7  # boilerplate that all share
        rows.append(mins)
    for k in range(60):
        near_copy = rows[k].copy()
        other = rng.random(near.HASHES) < 0.25
        near_copy[other] = rng.integers(0, 2**32, int(other.sum()), dtype=np.uint32)
        rows[k + 300] = near_copy
    table = [(b"c%03d" % k, bytearray(m.astype("<u4").tobytes())) for k, m in enumerate(rows)]
    classes = spark.createDataFrame(table, "cls binary, mins binary")
    nodes = classes.select(F.lit(1).cast("long").alias("node"), "cls", F.col("cls").alias("comp"), F.lit(3).alias("tree"))
    few, deep = near._branched(nodes, classes, block=50, branch=10)
    pick = lambda t: t.groupBy("node").agg(F.collect_set("cls").alias("c")).collect()
    together = [set(map(bytes, r["c"])) for r in [*pick(few), *pick(deep)]]
    met = sum(any({table[k][0], table[k + 300][0]} <= t for t in together) for k in range(60))
    assert met >= 55 and max(len(t) for t in together) < 300
    assert sum(len(t) ** 2 for t in together) < 600**2 / 2  # far fewer than all pairs


def test_a_group_with_a_large_node_in_each_tree_is_crossed_once(spark):
    """8 trees hold most of the same 300 classes, 180 of them of one component: no pair across components is lost, and rows are those of about one node."""
    rng = np.random.default_rng(21)
    names = [b"%03d" % k for k in rng.permutation(300)]
    comp = [b"c" if k < 180 else names[k] for k in range(300)]
    held = [np.sort(rng.choice(300, 210, replace=False)) for _ in range(8)]
    apart = [(b"x%02d" % k, b"x%02d" % k) for k in range(40)]  # a node that shares nothing with the others
    table = [(t, names[k], comp[k], t) for t, ks in enumerate(held) for k in ks] + [(99, *x, 3) for x in apart]
    rows = spark.createDataFrame(table, "node long, cls binary, comp binary, tree int")
    got = near._crossed(rows, 16).collect()
    met, groups = set(), {}
    for r in got:
        groups.setdefault(r["g"], ([], []))[r["side"]].append(bytes(r["cls"]))
    for asking, asked in groups.values():
        met |= {frozenset((a, b)) for a in asking for b in asked}
    label = dict(zip(names, comp, strict=True)) | dict(apart)
    want = {frozenset((names[a], names[b])) for ks in held for a in ks for b in ks} | {frozenset((a, b)) for a, _ in apart for b, _ in apart}
    assert {p for p in want if len(p) == 2 and len({label[x] for x in p}) == 2} <= met
    blocks, shares = -(-300 // 16), -(-120 // 16)
    assert len(got) <= 120 * blocks + 300 * shares + 40 * 3 * 2
    assert {r["tree"] for r in got if bytes(r["cls"]) in names} == {-1} and {r["tree"] for r in got if bytes(r["cls"]).startswith(b"x")} == {3}


@pytest.mark.parametrize("whole", [near.WHOLE, 100])
def test_a_group_of_nearly_similar_texts_makes_no_pair_of_every_two(spark, monkeypatch, whole):
    """200 texts with a similarity of 0.72 to one another, and links among some: only links come out of their nodes, but for sets too large to be sent there."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(50_000)])
    passage = rng.choice(words, 150)
    rows = [[*passage, *rng.choice(words, 28)] for _ in range(200)]
    rows += [[*rows[k], *rng.choice(words, 3)] for k in range(0, 200, 10)]
    table = [(k, " ".join(t)) for k, t in enumerate(rows)]
    made, by_group = [], near._by_group

    def counted(rows_, pick, schema):
        out = near.write_table(by_group(rows_, pick, schema), "made")
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "_by_group", counted)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = [tuple(r) for r in near.near_components(docs, leaf=8, block=32, branch=2, **({"whole": whole} if whole < near.WHOLE else {})).collect()]
    assert sorted(got) == sorted(brute.near_components(table))
    assert whole < near.WHOLE or made[-1] < 1000


def test_similar_counts_whole_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)] + [np.arange(k, dtype=np.uint64) for k in (1, 2, 3, 4)]
    i, j = np.triu_indices(len(sets), 1)
    want = [100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j, strict=True)]
    assert near.similar(sets, i, j, some=3).tolist() == want and any(want)
    assert near.similar(sets, i[:0], j[:0]).tolist() == []
