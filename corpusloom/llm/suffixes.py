"""Suffix-array deduplication of passages over the whole corpus.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller doc_id; strings are judged on the input and never cross documents.

1. Documents are written in blocks, compressed. Every window of ``length`` bytes has a
   content-chosen anchor (see anchors), and windows can only be equal if their anchors are.
2. Hashes of anchors, once a block each, are dealt into buckets. One that two documents have is repeated;
   the block gets back a bit for each. Windows of other anchors occur in one document
   only and go no further: about three quarters of a corpus.
3. For the rest each block sends every distinct context of an anchor (the bytes of its windows)
   with the smallest doc_id that has it to the anchor's bucket.
4. In a bucket, an anchor with one context needs no comparison. The contexts of all others are the text of a
   suffix array, built blockwise with a difference cover (see suffixsort): neighbours in it
   that agree in ``length`` bytes are one string, and each string gets its smallest doc_id.
5. Blocks get back, for runs of windows, a smaller doc_id than their own where there is one, and cut.

Contexts are compared byte by byte; hashes only route them. Copies within a block are one
context, so a hot passage reaches its bucket once a block, not once a document.

Blocks are written in buckets by their number, so that only notes are shuffled to them; sizes of blocks and buckets grow with
the square root of the corpus, which keeps the number of notes in proportion to it (see side()). A block is stored in pieces of at
most PIECE bytes, in row groups of a few of them: a JVM sets aside whole regions for every large row and column, and its heap grows by them.

Defined results: null or empty text has no bytes; rows that repeat a doc_id don't count as smaller
than one another; a null doc_id ranks after all others; an empty table gives no rows. Digests are those of all bytes left; where texts
are returned, bytes of a character that was cut in two go too.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.anchors import runs, shape
from corpusloom.llm.common import free_shuffles, new_path, short_batches, short_reads, write_table
from corpusloom.llm.suffixsort import classes

U = np.uint64
LAST = 2**63 - 1
PIECE, ROW_GROUP = 128 << 10, 1 << 20
BLOCK = "block long, piece int, data binary"
NOTE = "block long, bucket int, kind int, payload binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    import zstandard

    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _unsqueeze(raw: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    at = 8 * (1 + len(types))
    out = []
    for t, n in zip(types, np.frombuffer(data, "<i8", len(types), 8).tolist(), strict=True):
        out.append(np.frombuffer(data, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            share = np.cumsum(np.maximum(sizes, 0)) // block_bytes
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                rest = b.slice(i, j - i).select(list(range(2, b.num_columns)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as w:
                    w.write_batch(rest)
                ids = np.array([LAST if d is None else d for d in b.column(1).slice(i, j - i).to_pylist()], np.int64)
                data = np.frombuffer(b"".join(t for t in texts[i:j] if t), np.uint8)
                whole = _squeeze(ids, sizes[i:j], data, np.frombuffer(sink.getvalue(), np.uint8))
                pieces = [whole[k : k + PIECE] for k in range(0, len(whole), PIECE)]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(pieces), pa.int64()), "piece": pa.array(range(len(pieces)), pa.int32()), "data": pa.array(pieces, pa.binary())})
                block += 1

    named = docs.select(F.col("text").alias("_text"), F.col("doc_id").alias("_id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    return named.mapInArrow(run, BLOCK)


class Block:
    """One block's documents and the runs of their windows, sorted by anchor hash."""

    def __init__(self, pieces: pa.Table, length: int) -> None:
        data = pieces.sort_by("piece").column("data").to_pylist()
        self.length, (self.ids, self.sizes, self.data, self.rest) = length, _unsqueeze(b"".join(data), "i8", "i8", "u1", "u1")
        self.ends = np.cumsum(np.maximum(self.sizes, 0))
        key, anchor, first, last = runs(self.data, self.ends, length)
        order = np.argsort(key)
        self.key, self.anchor, self.first, self.last = key[order], anchor[order], first[order], last[order]
        self.doc = self.ids[np.searchsorted(self.ends, self.anchor, "right")] if len(key) else np.empty(0, np.int64)

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each hash once, where its runs begin, and whether two doc_ids have it."""
        new = np.concatenate([[True], self.key[1:] != self.key[:-1]])[: len(self.key)]
        at = np.flatnonzero(new)
        if not len(at):
            return self.key, at, np.empty(0, bool)
        return self.key[at], at, np.maximum.reduceat(self.doc, at) > np.minimum.reduceat(self.doc, at)

    def keep(self, bits: np.ndarray) -> None:
        """Drop runs of hashes whose bit is off."""
        _, at, _ = self.unique()
        on = np.repeat(bits, np.diff(np.append(at, len(self.key))))
        for name in ("key", "anchor", "first", "last", "doc"):
            setattr(self, name, getattr(self, name)[on])

    def contexts(self) -> np.ndarray:
        """The bytes of each run's windows at fixed places about its anchor, zeros elsewhere, and at the end the windows' range."""
        gram, width = shape(self.length)
        span = width - 1 + self.length
        slot = -(-(span + 4) // 8) * 8
        out = np.zeros((len(self.key), slot), np.uint8)
        if not len(out):
            return out
        padded = np.concatenate([np.zeros(span, np.uint8), self.data, np.zeros(span, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, span)
        at = np.arange(span)
        j0, j1 = self.range()
        for i in range(0, len(out), 1 << 15):
            s = slice(i, i + (1 << 15))
            own = view[self.anchor[s] - (width - 1) + span]
            out[s, :span] = np.where((at >= j0[s, None]) & (at < j1[s, None] + self.length), own, 0)
        out[:, slot - 4 :] = np.stack([j0, j1], 1).astype("<u2").view(np.uint8)
        return out

    def range(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run, counted from the first that could choose its anchor."""
        base = self.anchor - (shape(self.length)[1] - 1)
        return self.first - base, self.last - base


def _variants(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, context) and where in it each distinct context begins. Contexts that share a hash but not all bytes stay apart."""
    words = rows.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    order = np.lexsort((h, key))
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = key[order[1:]] != key[order[:-1]]
        for i in range(0, len(rows) - 1, 1 << 16):
            a, b = order[i + 1 : i + 1 + (1 << 16)], order[i : min(i + (1 << 16), len(rows) - 1)]
            new[i + 1 : i + 1 + len(a)] |= (words[a] != words[b]).any(1)
    return order, np.flatnonzero(new)


def _cuts(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes."""
    return np.searchsorted(((key >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1))


def _notes(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], ["block", "bucket", "kind", "payload"])


def _hashes(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 2: each block's hashes, a note a bucket."""

    def run(t: pa.Table) -> pa.Table:
        key, _, shared = Block(t, length).unique()
        cut = _cuts(key, buckets)
        number = t.column("block")[0].as_py()
        return _notes([(number, b, 0, _squeeze(key[i:j], np.packbits(shared[i:j]))) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j])

    return blocks.groupBy("block").applyInArrow(run, NOTE)


def _repeated(t: pa.Table) -> pa.Table:
    """Step 2, in a bucket: a bit for every hash of every block."""
    rows, own, shared = t.select(["block", "bucket", "payload"]).to_pylist(), [], []
    for r in rows:
        key, bits = _unsqueeze(r["payload"], "u8", "u1")
        own.append(key)
        shared.append(key[np.unpackbits(bits, count=len(key)).astype(bool)])
    both = np.sort(np.concatenate(own))
    again = np.unique(np.concatenate([both[1:][both[1:] == both[:-1]], *shared]))
    out = []
    for r, key in zip(rows, own, strict=True):
        at = np.searchsorted(again, key)
        hit = (again[np.minimum(at, len(again) - 1)] == key) if len(again) else np.zeros(len(key), bool)
        out.append((r["block"], r["bucket"], 0, np.packbits(hit).tobytes()))
    return _notes(out)


def _surviving(left: pa.Table, notes: list[dict], buckets: int, length: int) -> Block:
    block = Block(left, length)
    key, _, _ = block.unique()
    cut, bits = _cuts(key, buckets), np.zeros(len(key), bool)
    for n in notes:
        if n["kind"] == 0:
            i, j = cut[n["bucket"]], cut[n["bucket"] + 1]
            bits[i:j] = np.unpackbits(np.frombuffer(n["payload"], np.uint8), count=j - i)
    block.keep(bits)
    return block


def _sender(buckets: int, length: int):
    """Step 3: a block's distinct contexts of repeated anchors, a note a bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _notes([])
        block = _surviving(left, right.to_pylist(), buckets, length)
        rows = block.contexts()
        order, at = _variants(block.key, rows)
        if not len(at):
            return _notes([])
        key, least = block.key[order[at]], np.minimum.reduceat(block.doc[order], at)
        cut = _cuts(key, buckets)
        number = left.column("block")[0].as_py()
        first = order[at]
        return _notes([(number, b, 1, _squeeze(key[i:j], least[i:j], rows[first[i:j]])) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j])

    return run


def smallest(key: np.ndarray, doc: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """[context, window]: the rank of the smallest doc_id with the window's string; and the rank of ``doc`` itself."""
    gram, width = shape(length)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int32)
    order, at = _variants(key, rows)
    of = np.empty(len(key), np.int64)  # which distinct context each row is
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    first, least = order[at], np.minimum.reduceat(rank[order], at)
    out = np.repeat(least[:, None], width, 1)
    own = key[first]
    group = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(several):
        slot = rows.shape[1]
        text = rows[first[several]]
        j0, j1 = np.ascontiguousarray(text[:, slot - 4 :]).view("<u2").astype(np.int64).T
        text[:, slot - 4 :] = 0
        which, j = np.nonzero((np.arange(width) >= j0[:, None]) & (np.arange(width) <= j1[:, None]))
        cls = classes(text.ravel(), which * slot + j, length)
        best = np.full(int(cls.max()) + 1, len(doc), np.int32)
        np.minimum.at(best, cls, least[several][which])
        out[several[which], j] = best[cls]
    return out[of], rank


def _bucket(length: int):
    """Step 4: for every block's contexts the runs of windows that a smaller doc_id than the block's own has."""

    def run(t: pa.Table) -> pa.Table:
        slot = -(-(shape(length)[1] - 1 + length + 4) // 8) * 8
        rows, parts = t.select(["block", "bucket", "payload"]).to_pylist(), []
        for r in rows:
            key, least, ctx = _unsqueeze(r["payload"], "u8", "i8", "u1")
            parts.append((key, least, ctx.reshape(-1, slot)))
        key, least, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
        best, rank = smallest(key, least, ctx, length)
        del ctx
        ids = np.unique(least)
        out, i = [], 0
        for r, (k, *_) in zip(rows, parts, strict=True):
            own = best[i : i + len(k)]
            new = np.ones(own.shape, bool)
            new[:, 1:] = own[:, 1:] != own[:, :-1]
            new &= (own < rank[i : i + len(k), None]).any(1)[:, None]
            i += len(k)
            which, j = np.nonzero(new)
            if len(which):
                out.append((r["block"], r["bucket"], 1, _squeeze(k, which.astype("<u4"), j.astype("<u2"), ids[own[which, j]])))
        return _notes(out)

    return run


def removed(block: Block, notes: list[dict], buckets: int) -> np.ndarray:
    """Step 5: which bytes of a block go."""
    length, (_, width) = block.length, shape(block.length)
    rows = block.contexts()
    order, at = _variants(block.key, rows)
    hit = np.zeros(len(block.data) + 1, bool)
    if len(at):
        key, doc, size = block.key[order[at]], block.doc[order], np.diff(np.append(at, len(order)))
        least = np.minimum.reduceat(doc, at)
        cut = _cuts(key, buckets)
        said = {n["bucket"]: n["payload"] for n in notes if n["kind"] == 1}
        first, last = block.first[order], block.last[order]
        base = block.anchor[order] - (width - 1)
        for b in range(buckets):
            i, j = int(cut[b]), int(cut[b + 1])
            if i == j:
                continue
            best = np.repeat(least[i:j, None], width, 1)
            if b in said:
                k, which, start, value = _unsqueeze(said[b], "u8", "<u4", "<u2", "i8")
                if not np.array_equal(k, key[i:j]):
                    raise ValueError("a block's contexts have changed")
                end = np.append(np.where(which[1:] == which[:-1], start[1:], width), width)
                for w, s, e, v in zip(which.tolist(), start.tolist(), end.tolist(), value.tolist(), strict=True):
                    best[w, s:e] = v
            r = np.arange(at[i], at[j] if j < len(at) else len(order))
            of = np.repeat(np.arange(j - i), size[i:j])
            place = base[r, None] + np.arange(width)
            on = (place >= first[r, None]) & (place <= last[r, None]) & (doc[r, None] > best[of])
            hit[place[on]] = True
    count = np.cumsum(hit, dtype=np.int32 if len(hit) < 2**31 else np.int64)[: len(block.data)]
    gone = count > 0
    gone[length:] = count[length:] > count[: max(0, len(count) - length)]
    return gone


def _cutter(buckets: int, length: int, schema: T.StructType | None, names: list[str]):
    """Step 5: digests, or whole rows with what is left of their texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        notes = right.to_pylist()
        block = _surviving(left, notes, buckets, length)
        gone = removed(block, notes, buckets)
        rest = pa.ipc.open_stream(pa.py_buffer(block.rest)).read_all()
        out, start = [], 0
        for n, end in zip(block.sizes.tolist(), block.ends.tolist(), strict=True):
            g = gone[start:end]
            part = block.data[start:end]
            kept = part[~g].tobytes() if g.any() else part.tobytes()
            out.append((max(n, 0), int(g.sum()), int(np.count_nonzero(np.diff(g.view(np.int8), prepend=np.int8(0)) == 1)), kept, n < 0))
            start = end
        if schema is None:
            cols = [[x[k] for x in out] for k in range(3)]
            return pa.table([rest.column("c1"), *(pa.array(c, pa.int64()) for c in cols), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        texts = [None if x[4] else x[3].decode("utf-8", "ignore") for x in out]
        cols = []
        for i, c in enumerate(names):
            if c == "text":
                cols.append(pa.array(texts, pa.string()))
            elif c == "n_chars":
                cols.append(pa.array([None if t is None else len(t) for t in texts], rest.column(f"c{i}").type))
            else:
                cols.append(rest.column(f"c{i}"))
        return pa.table(cols, names)

    return run


def side(total: float, note: int = 16 << 10, least: int = 2 << 20, most: int = 32 << 20) -> int:
    """Bytes of a block and of a bucket for a corpus of ``total`` bytes.

    Every block sends a note to every bucket, so of ``total`` / side of both there are (``total`` / side)^2 notes. The square root of ``total`` * ``note``
    keeps a note at about ``note`` bytes of text and their number in proportion to the corpus, up to ``most``^2 / ``note`` (64 GB); beyond, notes get smaller.
    """
    return int(min(most, max(least, (total * note) ** 0.5)))


def _stored(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks as a table that is written in buckets by block, so that notes come to them and they are shuffled once, not at each step."""
    spark, name = blocks.sparkSession, f"corpusloom_blocks_{uuid.uuid4().hex}"
    path = new_path(spark, "blocks")
    # Pieces are compressed already; sizes of row groups and pages are looked at after each row, not after a hundred.
    small = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    blocks.repartition(parts, "block").write.format("parquet").options(path=path, **small).bucketBy(parts, "block").sortBy("block").saveAsTable(name)
    out = spark.table(name)
    out.stored_at = path
    spark.sql(f"DROP TABLE {name}")  # from the catalog: the files stay, and the plan has them
    return out


def dedup(docs: DataFrame, length: int = 50, block_bytes: int | None = None, bucket_bytes: int | None = None, texts: bool = True) -> DataFrame:
    """texts: the documents with all their columns, text (and n_chars, if there) as what is left; else the contract's digests.

    What is left of a text may begin or end inside a character of several bytes; its remaining bytes go too where texts are returned,
    while the digests are those of all bytes left. Sizes of blocks and buckets follow side() unless given; results don't depend on them.
    """
    spark = docs.sparkSession
    short_batches(spark)
    short_reads(spark)
    named = docs if texts else docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = min(100_000, max(spark.sparkContext.defaultParallelism, total // (16 << 20)))
    blocks = _stored(_blocks(named, block_bytes or side(total)), parts)
    buckets = max(1, -(-total // (bucket_bytes or side(total))))
    masks = write_table(_hashes(blocks, buckets, length).groupBy("bucket").applyInArrow(_repeated, NOTE), "repeated")
    free_shuffles(spark)
    sent = blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_sender(buckets, length), NOTE)
    answers = write_table(sent.groupBy("bucket").applyInArrow(_bucket(length), NOTE), "answers")
    free_shuffles(spark)
    notes = masks.unionByName(answers)
    if not texts:
        return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_cutter(buckets, length, None, []), DIGEST)
    return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_cutter(buckets, length, docs.schema, docs.columns), docs.schema)


def substring_dedup(docs: DataFrame, **more) -> DataFrame:
    return dedup(docs, texts=False, **more)
