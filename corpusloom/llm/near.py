"""MinHash near-dedup by a chosen-path set similarity join.

1. A document's set of word shingles gives its class (a 128-bit digest of the set, so exact copies
   are one class), its minwise tokens and a sketch of a byte of each.
2. A tree branches the classes recursively: a node holds those that chose the same tokens along its
   path, and a node of more than ``leaf`` classes branches by its next token. ``trees`` trees choose
   independent tokens. A pair of similarity 0.75 that small first-level nodes hold meets in one of 16 trees
   with probability 1 - 2e-10; one whose first-level nodes are all large, with 1 - 2e-6.
3. Small nodes are compared exhaustively, sketch against sketch; sizes and sketches rule pairs out (a sketch drops
   a true link with probability of a few millionths). A node that is still large at the last level holds
   classes that agree on all its tokens: it is cut into blocks, and its first class is
   compared with all. Of what passes, the best partners of each class and of each leader go on.
4. Pairs are confirmed on the full sets; links give connected components by star contraction.
5. Nodes that still hold several components are compared again, now with all pairs across
   components, so what step 3 held back is made up for, and components are formed once more. Large ones with many classes
   outside their leader's component are branched further first, level by level, by several tokens each, as long as
   that saves pairs; what no further token splits is compared in blocks, every class outside the leader's component with all.
   Sketches of 1024 tokens, made for the classes in these nodes only, rule out what isn't near. What they leave is confirmed where it
   meets, on whole sets, and only links come out: a group whose members are nearly, but not quite, similar enough has a pair
   of every two of them. Only sets of more than WHOLE shingles aren't sent there; their pairs are confirmed as in step 4.

Nothing of this is collected, and no group grows with a hot key: large nodes are blocks, and a node's size goes to its rows
without a shuffle by its key.

What is exact and what isn't: links are confirmed on whole sets of 64-bit hashes of shingles, and sets with the same 128-bit digest count as
equal; for a corpus of 2^32 unlike texts the chance that any two of them share a digest is 2^-65. Links are found by trees and
sketches: one of similarity 0.75 is missed with a probability of a few millionths; where its only common nodes are branched further, with
one of some hundredths for each of these. Nearer pairs are missed less.

Defined results: null or empty text, or text of blanks, has no shingles, is linked with nothing and is
its own component; rows that repeat a doc_id with equal texts belong to one class; a row
without doc_id takes its component's smallest id, or none; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import drop, free_shuffles, join_hot, short_batches, write_table
from corpusloom.llm.shingles import U, mix, shingle_set

HASHES = 64
DEPTH = 2
#: Levels that nodes with many components are branched further, and children of a class at each.
LEVELS, CHILDREN = 4, 3
_rng = np.random.default_rng(20240607)
_XOR, _MUL = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1) for _ in range(2))
FINE = 1024
#: Shingles of a set that is sent whole to the nodes of its class: 64 kB.
WHOLE = 8192
_FINE_XOR, _FINE_MUL = (_rng.integers(1, 2**63, FINE, dtype=np.uint64) * U(2) + U(1) for _ in range(2))
SIGNED = "doc_id long, cls binary, n_shingles long, mins binary, sketch binary"


def digest(s: np.ndarray) -> bytes:
    return np.array([np.sum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=np.uint64) + U(len(s)), np.sum(mix(s + U(0x14057B7EF767814F)), dtype=np.uint64)], ">u8").tobytes()


def fine_sketch(s: np.ndarray) -> bytes:
    """A byte of each of FINE more minwise tokens."""
    out = np.full(FINE, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 256):
        out = np.minimum(out, ((s[i : i + 256] ^ _FINE_XOR[:, None]) * _FINE_MUL[:, None]).min(1))
    return ((out >> U(40)) & U(255)).astype(np.uint8).tobytes()


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest of the set's elements under every hash, by their upper halves."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, ((s[i : i + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(1))
    return (out >> U(32)).astype("<u4")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n, mins, sketch = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                m = minwise(s) if len(s) else None
                cls.append(digest(s) if len(s) else None)
                mins.append(m.tobytes() if len(s) else None)
                sketch.append(((m >> 3) & 255).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(mins, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "cls", "n_shingles", "mins", "sketch"])

    return docs.mapInArrow(run, SIGNED)


def grow_trees(classes: DataFrame, trees: int, leaf: int) -> list[DataFrame]:
    """Tables of node, cls, n, tree: the nodes of two to ``leaf`` classes, level by level; last the large nodes of the last level, if any."""
    token = lambda tree, i: F.substring(F.col("mins"), 4 * ((tree + i * trees) % HASHES) + 1, F.lit(4))
    first = F.array(*[F.xxhash64(F.lit(t), token(F.lit(t), 0)) for t in range(trees)])
    # A node's key is its tree and the tokens chosen so far. Only classes of large nodes get deeper keys.
    deeper = F.array(*[F.xxhash64("tree", *[token(F.col("tree"), i) for i in range(level)]) for level in range(2, DEPTH + 1)])
    rows, total, out = classes.select("cls", F.posexplode(first).alias("tree", "node")), classes.count() * trees, []
    for level in range(1, DEPTH + 1):
        # A node that holds a third of all classes isn't shuffled by its key: its size, made of partial counts, goes to its rows.
        sizes = write_table(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{level}")
        nodes = write_table(join_hot(rows, sizes, "node", "n", total), f"nodes-{level}")
        drop(sizes)
        large = nodes.where(F.col("n") > leaf)
        out.append(nodes.where(F.col("n") <= leaf).select("node", "cls", "n", "tree"))
        if large.isEmpty():
            return out
        if level == 1:
            rows = large.select("cls", "tree").join(classes.select("cls", "mins"), "cls").select("cls", "tree", deeper.alias("keys"))
        if level < DEPTH:
            total = large.count()
            rows = (rows if level == 1 else large).select("cls", "tree", "keys", F.col("keys")[level - 1].alias("node"))
    return [*out, large.select("node", "cls", "n", "tree")]


def compare(g: np.ndarray, sketch: np.ndarray, n: np.ndarray, side: np.ndarray, comp: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of the same group (rows are sorted by it) that sizes and sketches allow to be links, with matching sketch bytes."""
    found, at, lag = [], np.arange(max(0, len(g) - 1)), 1
    while len(at := at[at + lag < len(g)]) and len(at := at[g[at] == g[at + lag]]):
        i, j = at, at + lag
        ok = 100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])
        ok &= (side[i] != side[j]) | (side[i] == 2)
        if comp is not None:
            ok &= comp[i] != comp[j]
        i, j = i[ok], j[ok]
        same = (sketch[i] == sketch[j]).sum(1)
        good = same >= least
        found.append((i[good], j[good], same[good]))
        lag += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_group(rows: DataFrame, pick, schema: str) -> DataFrame:
    """``pick`` over tables of whole groups g of rows (g, side, cls, sketch, n_shingles, comp, tree, mins), asking sides first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            g = rest.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if cut:
                yield pick(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield pick(rest)

    cols = rows.select("g", "side", "cls", "sketch", "n_shingles", "comp", "tree", "mins", *[c for c in rows.columns if c == "whole"])
    return cols.repartition("g").sortWithinPartitions("g", F.col("side").desc(), "cls").mapInArrow(run, schema)


def _found(t: pa.Table, across: bool, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, n, side = (t.column(c).to_numpy() for c in ("g", "n_shingles", "side"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(g), -1)
    comp = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)[1] if across else None
    return compare(g, sketch, n, side, comp, least)


def _asking(rows: DataFrame, least: int) -> DataFrame:
    """The rows (g, side, cls, comp, tree) that sketches allow a link to another component, so that only these need finer ones."""

    def pick(t: pa.Table) -> pa.RecordBatch:
        i, j, _ = _found(t, True, least)
        use = np.unique(np.concatenate([i, j]))
        return t.select(["g", "side", "cls", "comp", "tree"]).take(pa.array(use)).combine_chunks().to_batches()[0] if len(use) else pa.RecordBatch.from_pylist([], t.select(["g", "side", "cls", "comp", "tree"]).schema)

    return _by_group(rows, pick, "g long, side int, cls binary, comp binary, tree int")


def _ordered(t: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of pairs, the smaller first, and which pairs are of two."""
    cls = np.array(t.column("cls").to_pylist(), object)
    a, b = cls[i], cls[j]
    swap = a > b
    return np.stack([np.where(swap, b, a), np.where(swap, a, b)]), a != b


def _candidates(rows: DataFrame, least: int) -> DataFrame:
    """Candidate pairs a < b: the best partner of each row, and all of its group's first row."""

    def pick(t: pa.Table) -> pa.RecordBatch:
        i, j, same = _found(t, False, least)
        if len(i):
            g = t.column("g").to_numpy()
            first = np.concatenate([[True], g[1:] != g[:-1]])
            who, other = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((other, -np.tile(same, 2), who))
            best = other[order[np.concatenate([[True], np.diff(who[order]) > 0])]]
            use = np.unique(np.concatenate([best, np.flatnonzero(first[i])]))
            i, j = i[use], j[use]
        (a, b), ok = _ordered(t, i, j)
        return pa.RecordBatch.from_arrays([pa.array(a[ok].tolist(), pa.binary()), pa.array(b[ok].tolist(), pa.binary())], ["a", "b"])

    return _by_group(rows, pick, "a binary, b binary").distinct()


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, some: int = 128) -> np.ndarray:
    """Which pairs of sorted sets have a similarity of 0.75 or more."""
    out, order = np.zeros(len(i), bool), np.argsort(i, kind="stable")
    cuts = [*np.flatnonzero(np.diff(i[order], prepend=-1)).tolist(), len(order)]
    for lo, hi in itertools.pairwise(cuts):
        one = sets[i[order[lo]]]
        for at in range(lo, hi, some):
            pairs = order[at : min(hi, at + some)]
            others = [sets[k] for k in j[pairs]]
            sizes = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            common = np.add.reduceat(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[pairs] = 100 * common >= 75 * (len(one) + sizes - common)
    return out


def _links_across(rows: DataFrame, least: int, trees: int) -> DataFrame:
    """Pairs a < b of different components of rows that have their whole sets: links, sure; and pairs of sets too large for that, which aren't sure.

    Sides 0 and 1 are compared with each other, side 2 with all. A pair is taken from the first tree whose whole path the two share (or from wherever
    they meet, if they share none).
    """

    def pick(t: pa.Table) -> pa.RecordBatch:
        i, j, _ = _found(t, True, least)
        mins, tree = np.frombuffer(b"".join(t.column("mins").to_pylist()), "<u4").reshape(len(t), HASHES), t.column("tree").to_numpy()
        equal = mins[i] == mins[j]
        path = np.all([equal[:, [(k + level * trees) % HASHES for k in range(trees)]] for level in range(DEPTH)], 0)
        own = ~path.any(1) | (path.argmax(1) == tree[i]) | (tree[i] < 0)
        i, j = i[own], j[own]
        whole = t.column("whole").to_pylist()
        known = np.array([x is not None for x in whole], bool)
        sure = known[i] & known[j]
        good = ~sure
        good[sure] = similar([np.frombuffer(x or b"", "<u8") for x in whole], i[sure], j[sure])
        (a, b), ok = _ordered(t, i, j)
        ok &= good
        return pa.RecordBatch.from_arrays([pa.array(a[ok].tolist(), pa.binary()), pa.array(b[ok].tolist(), pa.binary()), pa.array(sure[ok])], ["a", "b", "sure"])

    return _by_group(rows, pick, "a binary, b binary, sure boolean").distinct()


def _sets(need: DataFrame, docs: DataFrame, classes: DataFrame, size: int, small: int = 1_000_000) -> DataFrame:
    """cls and shingles, a written table, of the classes in ``need`` (cls): made again from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "shingles"])

    owners = write_table(need.join(classes.select("cls", "first_id"), "cls"), "set-owners")
    ids = owners.select(F.col("first_id").alias("need_id")).distinct()
    if owners.count() <= small:  # at most 16 MB of ids
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.expr("doc_id <=> need_id"), "left_semi").select("text")
    made = texts.mapInArrow(run, T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType(), True))]))
    one = made.join(owners.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.any_value("shingles").alias("shingles"))
    out = write_table(one, "sets")
    drop(owners)
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, most: int = 1000) -> DataFrame:
    """The pairs whose full sets have a similarity of 0.75 or more. A class that is the first of more than ``most`` pairs, as leaders are, has its set sent to several tasks."""
    heavy = write_table(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("long").alias("shares")).where("shares > 1"), "heavy")
    known = F.broadcast(heavy) if heavy.count() <= 1_000_000 else heavy  # at most 24 MB
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    dealt = pairs.join(known, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), shares).alias("share"))
    first = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")).join(known, "a", "left")
    left = dealt.join(first.select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share")), ["a", "share"])
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = write_table(both.where(100 * common >= 75 * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    drop(heavy)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _fine_sketches(sets: DataFrame, most: int) -> DataFrame:
    """cls, sketch, and whole, the set itself as bytes if it has at most ``most`` elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.sort(s.values.to_numpy().view(np.uint64)) for s in b.column(1)]
            sketches, whole = [fine_sketch(s) for s in found], [s.astype("<u8").tobytes() if len(s) <= most else None for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketches, pa.binary()), pa.array(whole, pa.binary())], ["cls", "sketch", "whole"])

    return sets.mapInArrow(run, "cls binary, sketch binary, whole binary")


def components(links: DataFrame) -> DataFrame:
    """cls, comp for every class in a link: connected components by alternating large and small stars until the edges stay as they are."""
    edges, seen = write_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct())
        seen = state
        # Large star: all larger neighbours of u go to the smallest around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # The centre of a large component has edges to all of it: its least neighbour goes to them.
        wide = join_hot(both.where("v > u"), write_table(least, "least"), "u", "n", 2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of these.
        wide = write_table(wide, "stars")
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        new = write_table(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(edges, wide)
        edges = new


def _leading(rows: DataFrame) -> DataFrame:
    """node, n, lead, outside of rows (node, cls, comp): the component with most of a node's classes, and how many classes aren't in it."""
    each = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
    most = each.groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("most"))
    return most.select("node", "n", F.col("most.comp").alias("lead"), (F.col("n") - F.col("most.c")).alias("outside"))


def _outside(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, cls, comp, tree) with blocks and block; and of each node with several components blocks, lead and ``outside``: how many classes aren't in that component.

    It is the component with most of a node's classes. All joins go by node and block: a node that holds a third of all classes is as many keys as it has blocks.
    """
    sizes = write_table(_leading(rows), "node-sizes")
    total = rows.count()
    dealt = join_hot(rows, sizes.where("outside > 0").select("node", "n", "lead", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "node", "n", total)
    dealt = write_table(dealt.withColumn("block", F.pmod(F.xxhash64("cls", "node"), F.col("blocks"))), "mixed-large")
    counts = dealt.groupBy("node").agg(F.max("blocks").alias("blocks"), F.max("n").alias("n"), F.count(F.when(F.col("comp") != F.col("lead"), 1)).alias("outside"))
    drop(sizes)
    return dealt, write_table(counts, "outside")


def _branched(rows: DataFrame, classes: DataFrame, block: int, branch: int) -> tuple[DataFrame, DataFrame]:
    """Large nodes with many classes outside their leading component, branched by further tokens: what has become small, and what hasn't.

    A class goes to CHILDREN nodes, one for each of the tokens that the node's key picks, so a pair of similarity 0.75 still meets in one
    with probability 0.98. Children of one component end there. A node whose children would have most of its pairs to compare again
    isn't branched; such nodes, those with few classes outside, and what all levels leave large are for _crossed().
    """
    few, rest = [], []

    def of(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
        return dealt.join(nodes.select("node", _every("blocks")), ["node", "block"], "left_semi").select("node", "cls", "comp", "tree")

    for level in range(LEVELS):
        dealt, counts = _outside(rows, block)
        heavy = counts.where(F.col("outside") > branch)
        rest.append(of(dealt, counts.where(F.col("outside") <= branch)))
        if heavy.isEmpty():
            return _union(few, rows), _union(rest, rows)
        # Children of a node; a tree number below zero means that no pair is left to another tree.
        token = lambda k: F.substring("mins", (4 * F.pmod(F.xxhash64("node", F.lit(k)), F.lit(HASHES)) + 1).cast("int"), F.lit(4))
        children = F.explode(F.array(*[F.xxhash64("node", F.lit(k), token(k)) for k in range(CHILDREN)])).alias("child")
        made = of(dealt, heavy).join(classes.select("cls", "mins"), "cls").select("node", children, "cls", "comp")
        made = write_table(made.distinct(), f"children-{level}")
        sizes = made.groupBy("child").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        sizes = write_table(sizes.select("child", "node", "n"), "children-sizes")
        work = sizes.groupBy("node").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        judged = write_table(heavy.join(work, "node", "left").withColumn("less", F.coalesce("work", F.lit(0.0)) < 0.7 * F.col("n").cast("double") * F.col("n")), "judged")
        rest.append(of(dealt, judged.where("not less")))
        taken = sizes.join(judged.where("less").select("node"), "node", "left_semi").select("child", "n")
        sized = write_table(join_hot(made.drop("node"), taken, "child", "n", made.count()).select(F.col("child").alias("node"), "cls", "comp", F.lit(-1).alias("tree"), "n"), f"mixed-children-{level}")
        drop(made)
        few.append(sized.where(F.col("n") <= block).select("node", "cls", "comp", "tree"))
        rows = sized.where(F.col("n") > block).select("node", "cls", "comp", "tree")
    return _union(few, rows), _union([*rest, rows], rows)


def _union(tables: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0).select("node", "cls", "comp", F.lit(0).alias("tree"))
    for t in tables:
        out = out.unionByName(t)
    return out


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias("block")


def _merged(rows: DataFrame) -> DataFrame:
    """The rows (node, cls, comp, tree) with nodes that mostly share their classes made one: what a group has in common gives it a large node in each tree.

    A node goes with the one that is, for most of its classes, the largest they are in. All pairs of the merged nodes still meet, and once. Nodes
    are left as they are where that would give more pairs to compare. A merged node's tree number is below zero.
    """
    rows = write_table(rows, "deep")
    sizes, total = write_table(_leading(rows), "deep-sizes"), rows.count()
    sized = join_hot(rows, sizes, "node", "n", total).select("node", "cls", "n")
    top = sized.groupBy("cls").agg(F.max(F.struct("n", "node"))["node"].alias("up"))
    votes = rows.select("node", "cls").join(top, "cls").groupBy("node", "up").agg(F.count("*").alias("c"))
    ups = votes.groupBy("node").agg(F.max(F.struct("c", "up"))["up"].alias("up")).join(sizes, "node")
    ups = write_table(ups.select("node", "up", "n", (F.col("n").cast("double") * F.col("outside")).alias("work")), "deep-ups")
    # A node goes only with one that stays where it is.
    roots = ups.where("node = up").select(F.col("node").alias("root"))
    member = ups.join(roots, ups["up"] == roots["root"]).select("node", "root", "n", "work")
    member = write_table(member.join(member.groupBy("root").agg(F.count("*").alias("nodes")).where("nodes > 1").select("root"), "root", "left_semi"), "deep-members")
    joined = write_table(join_hot(rows, member, "node", "n", total).select(F.col("root").alias("node"), "cls", "comp").distinct(), "deep-merged")
    before = member.groupBy(F.col("root").alias("node")).agg(F.sum("work").alias("before"))
    less = _leading(joined).join(before, "node").where(F.col("n").cast("double") * F.col("outside") <= F.col("before"))
    less = write_table(less.select(F.col("node").alias("root"), F.col("n").alias("all")), "deep-less")
    gone = member.join(less, "root", "left_semi").select("node", "n")
    taken = join_hot(joined, less.select(F.col("root").alias("node"), "all"), "node", "all", joined.count()).select("node", "cls", "comp", F.lit(-1).alias("tree"))
    stay = sizes.join(gone.select("node"), "node", "left_anti").select("node", "n")
    out = write_table(join_hot(rows, stay, "node", "n", total).select("node", "cls", "comp", "tree").unionByName(taken), "deep-nodes")
    drop(rows, sizes, ups, member, joined, less)
    return out


def _crossed(rows: DataFrame, block: int) -> DataFrame:
    """Rows (g, side, cls, comp, tree) in which every class outside its node's leading component meets all classes of the node, block by block."""
    dealt, counts = _outside(_merged(rows), block)
    counts = counts.where("outside > 0").withColumn("shares", F.ceil(F.col("outside") / block).cast("long")).select("node", "blocks", "shares", _every("blocks"))
    both = dealt.drop("blocks").join(counts, ["node", "block"])
    share = F.pmod(F.xxhash64("cls", "node", F.lit("share")), F.col("shares"))
    asking = both.where(F.col("comp") != F.col("lead")).select("node", share.alias("share"), "cls", "comp", "tree", _every("blocks"))
    asked = both.select("node", "block", "cls", "comp", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    out = [t.select(F.xxhash64("node", "block", "share").alias("g"), F.lit(side).alias("side"), "cls", "comp", "tree") for side, t in enumerate((asking, asked))]
    return out[0].unionByName(out[1])


def near_components(docs: DataFrame, size: int = 5, trees: int = 16, leaf: int = 64, block: int = 512, branch: int = 256, least: int = 32, least_fine: int = 702, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short_batches(spark)
    signed = write_table(signatures(docs, size), "signatures")
    classes = write_table(
        signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("mins").alias("mins"), F.any_value("sketch").alias("sketch")),
        "classes",
    )
    levels = grow_trees(classes, trees, leaf)
    small = levels[0]
    for t in levels[1:DEPTH]:
        small = small.unionByName(t)
    large = levels[DEPTH] if len(levels) > DEPTH else None
    own = classes.select("cls", "sketch", "n_shingles", "mins")
    blank = F.lit(None).cast("binary")
    rows = small.select(F.col("node").alias("g"), F.lit(2).alias("side"), "cls", blank.alias("comp"), "tree")
    if large is not None:
        large = large.withColumns({"blocks": F.ceil(F.col("n") / block).cast("long")})
        large = write_table(large.withColumn("block", F.pmod(F.xxhash64("cls", "node"), F.col("blocks"))), "large-nodes")
        leaders = write_table(large.groupBy("node").agg(F.min("cls").alias("cls"), F.max("blocks").alias("blocks"), F.max("tree").alias("tree")), "leaders")
        spread = leaders.select("node", "cls", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        rows = rows.unionByName(large.select(F.xxhash64("node", "block").alias("g"), F.lit(1).alias("side"), "cls", blank.alias("comp"), "tree"))
        rows = rows.unionByName(spread.select(F.xxhash64("node", "block").alias("g"), F.lit(2).alias("side"), "cls", blank.alias("comp"), "tree"))
        # within a block members are compared with one another too
        rows = rows.withColumn("side", F.lit(2))
    tested = write_table(_candidates(rows.join(own, "cls"), least), "pairs")
    sets = _sets(_ends(tested), docs, classes, size)
    links = _confirm(tested, sets)
    drop(sets)
    comps = write_table(components(links), "components")

    # Nodes with several components: all pairs across them that haven't been tested.
    def labelled(t: DataFrame) -> DataFrame:
        return t.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    marked = labelled(small)
    mixed = marked.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
    rows = marked.join(mixed, "node", "left_semi").select(F.col("node").alias("g"), F.lit(2).alias("side"), "cls", "comp", "tree")
    if large is not None:
        few, deep = _branched(labelled(large).select("node", "cls", "comp", "tree"), classes, block, branch)
        rows = rows.unionByName(few.select(F.col("node").alias("g"), F.lit(2).alias("side"), "cls", "comp", "tree"))
        rows = rows.unionByName(_crossed(deep, block))
    rows = write_table(_asking(rows.join(own, "cls"), least), "mixed-nodes")
    if not rows.isEmpty():
        sets = _sets(rows.select("cls").distinct(), docs, classes, size)
        fine = write_table(_fine_sketches(sets, whole).join(classes.select("cls", "n_shingles", "mins"), "cls"), "fine-sketches")
        # Whole sets go only to the nodes where sketches leave a pair of theirs.
        rows = write_table(_asking(rows.join(fine.drop("whole"), "cls"), least_fine), "near-nodes")
        found = write_table(_links_across(rows.join(fine, "cls"), least_fine, trees), "links-across")
        more = write_table(found.where("not sure").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(found.where("sure").select("a", "b")).unionByName(_confirm(more, sets))
        comps = write_table(components(links), "components")
        drop(sets, fine)
    free_shuffles(spark)

    named = comps.join(classes.select("cls", "first_id"), "cls").groupBy("comp").agg(F.min("first_id").alias("component_id"))
    label = classes.select("cls", "first_id", "n_docs").join(comps, "cls", "left").join(named, "comp", "left")
    label = write_table(label.select("cls", "n_docs", F.coalesce("component_id", "first_id").alias("component_id")).where("n_docs > 1 or component_id is not null"), "labels")
    out = join_hot(signed.select("doc_id", "cls", "n_shingles"), label, "cls", "n_docs", signed.count(), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, **more) -> DataFrame:
    """The documents, with all their columns, whose id is their component's smallest. Rows that repeat a doc_id stay or go together; rows without one stay."""
    gone = write_table(near_components(docs, **more).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "near-copies")
    if gone.count() <= 1_000_000:  # at most 16 MB
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
