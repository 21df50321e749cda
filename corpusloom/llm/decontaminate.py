"""Benchmark decontamination with suffix arrays of the documents.

The documents are read in shards. A shard's words become numbers in the vocabulary of the
tests, zero for any other word and between documents, and a suffix array is built over
the stretches of test words. Every suffix of every test item is looked up in it by
binary search, all together, one word deeper at a time: that gives its longest verbatim
match, however short, and the interval of its locations. Shards need nothing of one another, so nothing is shuffled.

Tests are sent to the executors in blocks of at most ``block_bytes`` of text. One block is one pass over the documents.
Of several, each is searched in a job of its own, whose hits are written before the next block is sent and this one's
broadcast is dropped; so neither a task's memory, nor its number of Python workers, nor a broadcast grows with the benchmark.

Defined results: null or empty text has no words, isn't hit and isn't contaminated; items
without words match nothing; repeated items and documents are treated one by one (an item_id
counts once); a null item_id matches but isn't listed; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import short_batches, write_table

WINDOW = 13
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("longest", T.LongType()), T.StructField("longest_start", T.LongType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())), ("longest", pa.int64()), ("longest_start", pa.int64())])
_tests: dict[str, Tests] = {}


def words(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, a piece of about 1 MB at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + (1 << 20))
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Tests:
    """A block of test items, as numbers; every suffix of it is a query."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.window, self.vocabulary, self.ids = window, {}, []
        text, start, left, need, item = [0], [], [], [], []
        for item_id, t in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for part in words(t or "") for w in part]
            if own:
                n, size = len(own), min(window, len(own))
                start += range(len(text), len(text) + n)
                left += range(n, 0, -1)
                need += [size if n - k >= size else 0 for k in range(n)]  # the window that starts at this suffix
                item += [len(self.ids)] * n
                self.ids.append(item_id)
                text += [*own, 0]
        self.text, self.start, self.left, self.need, self.item = (np.array(x, np.int64) for x in (text, start, left, need, item))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of numbers, sorted by their first ``depth`` of them, by prefix doubling."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        nxt = np.zeros_like(rank)
        nxt[:-k] = rank[k:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + nxt if len(rank) else rank, return_inverse=True)
        if len(rank) and rank.max() + 1 == len(rank):
            break
        rank = rank + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, sa: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query the interval of its window's locations in ``sa``; for every suffix in ``sa`` its longest match with any query."""
    n = len(tests.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    wlo, whi, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(len(sa), np.int64)
    active, depth = np.arange(n), 0
    padded = np.append(text, 0)

    def bound(q: np.ndarray, right: bool) -> np.ndarray:
        a, b, want = lo[q].copy(), hi[q].copy(), tests.text[tests.start[q] + depth]
        while (going := a < b).any():
            mid = (a + b) >> 1
            got = padded[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(text))]
            up = going & ((got <= want) if right else (got < want))
            a, b = np.where(up, mid + 1, a), np.where(going & ~up, mid, b)
        return a

    while len(active) and len(sa):
        a, b = bound(active, False), bound(active, True)
        ok = a < b
        active = active[ok]
        lo[active], hi[active] = a[ok], b[ok]
        depth += 1
        # Intervals of one depth are equal or apart, so each suffix is met once a depth at most.
        longest[_spread(*np.unique(np.stack([lo[active], hi[active]]), axis=1))[0]] = depth
        full = active[tests.need[active] == depth]
        wlo[full], whi[full] = lo[full], hi[full]
        active = active[tests.left[active] > depth]
    return wlo, whi, longest


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals, and which interval each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def scan_shard(texts: list[str | None], tests: Tests) -> list[dict]:
    """What of the tests each text holds: word runs hit, items, and the words and first place of the longest match."""
    get, own = tests.vocabulary.get, [np.zeros(1, np.int32)]
    sizes = []
    for t in texts:
        ids = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in words(t or "")]
        sizes.append(sum(map(len, ids)))
        own += [*ids, np.zeros(1, np.int32)]
    text, at = np.concatenate(own), 1 + np.cumsum([0, *(s + 1 for s in sizes)])[:-1]  # where each document begins
    out = [{"n_words": s, "starts": [], "ends": [], "items": [], "longest": 0, "longest_start": None} for s in sizes]
    edge = np.diff(np.concatenate([[0], (text > 0).astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(s):
        return out
    where, _ = _spread(s, e + 1)  # the stretches of test words, with a zero after each
    part = text[where].astype(np.int64)
    sa = suffix_array(part, min(int(tests.left.max()), int((e - s).max())))
    sa = sa[part[sa] > 0]
    wlo, whi, longest = search(part, sa, tests)
    rows, q = _spread(wlo, whi)
    pos, size = where[sa[rows]], tests.need[q]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + size, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]]))
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        d = int(np.searchsorted(at, i, "right")) - 1
        out[d]["starts"].append(i - int(at[d]))
        out[d]["ends"].append(j - int(at[d]))
    doc = np.searchsorted(at, pos, "right") - 1
    for d, k in np.unique(np.stack([doc, tests.item[q]], 1), axis=0).tolist():
        if tests.ids[k] is not None and tests.ids[k] not in out[d]["items"]:
            out[d]["items"].append(tests.ids[k])
    some = longest > 0
    pos, deep = where[sa[some]], longest[some]
    doc = np.searchsorted(at, pos, "right") - 1
    order = np.lexsort((pos, -deep, doc))
    first = order[np.concatenate([[True], np.diff(doc[order]) > 0])] if len(order) else order
    for d, n, i in zip(doc[first].tolist(), deep[first].tolist(), pos[first].tolist(), strict=True):
        out[d]["longest"], out[d]["longest_start"] = n, i - int(at[d])
    return out


def _merge(parts: list[dict], n_words: int) -> dict:
    """What several blocks of tests found in one document."""
    starts, ends = [], []
    for i, j in sorted(x for p in parts for x in zip(p["starts"], p["ends"], strict=True)):
        if starts and i <= ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    longest, first = min(((-p["longest"], p["longest_start"]) for p in parts if p["longest"]), default=(0, None))
    return {"n_words": n_words, "starts": starts, "ends": ends, "items": sorted({i for p in parts for i in p["items"]}), "longest": -longest, "longest_start": first}


def _blocks(tests: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The tests in blocks of bounded size, one at a time on the driver."""
    block: list[tuple] = []
    size = 0
    for r in tests.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches whose column ``text`` has about ``shard_bytes`` at most."""
    for batch in batches:
        sizes = np.cumsum([len(t or "") for t in batch.column("text").to_pylist()]) // shard_bytes if len(batch) else np.zeros(0)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(batch)]
        yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False))


def _sent(key: str, sent, window: int) -> Tests:
    """The tests of a broadcast, made once a worker; only the last ones are kept."""
    if key not in _tests:
        _tests.clear()
        _tests[key] = Tests(sent.value, window)
    return _tests[key]


def find_tests(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20, shard_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """doc (a struct of the other columns), text and ``found``, a struct of FOUND: n_words, runs of words hit [starts, ends), items, longest match and its first place."""
    spark = docs.sparkSession
    rest = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    short_batches(spark)
    blocks = _blocks(tests, block_bytes)
    block, following = next(blocks), next(blocks, None)
    rows = docs.select(F.struct(*rest).alias("doc"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("found", FOUND)])
    if following is None:
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _sent(key, sent, window)
            for b in _shards(batches, shard_bytes):
                texts = b.column("text")
                yield pa.RecordBatch.from_arrays([b.column("doc"), texts if keep_text else pa.nulls(len(b), pa.string()), pa.array(scan_shard(texts.to_pylist(), own), _ARROW)], schema.names)

        return rows.mapInArrow(run, schema)

    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    hits = []
    while block is not None:
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def hit(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            own = _sent(key, sent, window)
            for b in _shards(batches, shard_bytes):
                found = scan_shard(b.column("text").to_pylist(), own)
                some = [k for k, f in enumerate(found) if f["longest"]]
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(some, pa.int64())), pa.array([found[k] for k in some], _ARROW)], ["row", "found"])

        hits.append(write_table(rows.select("row", "text").mapInArrow(hit, T.StructType([T.StructField("row", T.LongType()), T.StructField("found", FOUND)])), "hits"))
        sent.destroy()
        block, following = following, next(blocks, None)
    parts = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.collect_list("found").alias("parts"))  # a part a block at most
    joined = rows.join(parts, "row", "left").select("doc", "text", "parts")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            found = [_merge(p or [], p[0]["n_words"] if p else sum(map(len, words(t or "")))) for p, t in zip(b.column("parts").to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), texts if keep_text else pa.nulls(len(b), pa.string()), pa.array(found, _ARROW)], schema.names)

    return joined.mapInArrow(merge, schema)


def n_hit(found: Column) -> Column:
    return F.aggregate(F.zip_with(found["starts"], found["ends"], lambda i, j: j - i), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(found: Column) -> Column:
    """At least a twentieth of the words is in windows of the tests."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def contamination(docs: DataFrame, tests: DataFrame, **more) -> DataFrame:
    """The contract's row for every document, the runs of words hit (first to the one after the last), and its longest match and where that begins, in words."""
    found = find_tests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tests, keep_text=False, **more)
    f = F.col("found")
    ids = F.array_join(F.sort_array(F.transform(f["items"], lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        f["n_words"].alias("n_words"),
        n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"),
        F.array_join(F.zip_with(f["starts"], f["ends"], lambda i, j: F.concat_ws("-", i.cast("string"), j.cast("string"))), ",").alias("hit_spans"),
        f["longest"].alias("longest_match"),
        f["longest_start"].alias("longest_start"),
    )


def remove_contaminated(docs: DataFrame, tests: DataFrame, **more) -> DataFrame:
    """The documents, with all their columns, that aren't contaminated."""
    kept = find_tests(docs, tests, **more).where(~contaminated(F.col("found")))
    return kept.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
