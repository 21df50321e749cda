"""Best-fit packing of documents into sequences, with certified bin counts.

1. Every document becomes its ids and an end id; longer ones are cut from the back into full
   sequences, so only the first piece is shorter. Ids are made once; only lengths and checksums go on.
2. Pieces are dealt into partitions of a bounded size, and each is packed by best-fit
   decreasing over a table of open bins by room left.
3. Dual feasible functions bound from below how many bins any packing of the partition needs. A
   partition that meets its bound is certified and final.
4. The others are repacked. Within a partition, a few bins give up their pieces, and these are packed again in
   decreasing order, a little perturbed: each bin takes the first piece left and the set of others that fills it best. What needs
   fewer bins, or as many but leaves the room in fewer of them, stays. That ends when the bound is met, or after ``tries`` attempts.
5. Partitions that still have a gap keep their full bins and exchange the pieces of all other bins: these are
   dealt anew into fewer, fuller partitions, and steps 2 to 4 run again, in one last partition as in several, until all
   are certified, the sum meets the bound of the whole input, or a round saves no bin.

Every piece carries its certificate: ``bins``, the sequences of the whole result, and ``bound``, which no packing can go below.

Defined results: null or empty text is a document of the end id alone; repeated rows are
packed as documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop, short_batches, write_table

#: Outside these code points two regex engines may class characters by different versions of Unicode.
_PLAIN = re.compile("[^\x00-ɏ‐-‰€]")
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them for ``json_path``.

    Texts of plain characters go through tiktoken's faster engine with the same vocabulary
    and pattern (``ranks_path``; None: never), all others through tokenizers itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is not None and not _PLAIN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


def pieces(docs: DataFrame, encoding: tuple[str, str | None, str | None], size: int, end: int) -> DataFrame:
    """The pieces of all documents, with a number each that is unique in the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, uid = encoder(*encoding), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text), np.uint32(end)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % size or size, n, size), n]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), uid))
                    uid += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", uid long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and what each bin holds, by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r is set if a bin has room r
    sizes = lengths.tolist()
    for i in order.tolist():
        n = sizes[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = bin_, fill[bin_]
        fill[bin_] += n
        if left := room - n:
            open_bins[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def repack(lengths: np.ndarray, bins: np.ndarray, size: int, bound: int, seed: int, tries: int) -> np.ndarray:
    """Bins of a packing that needs as few of them or fewer. At each try some bins, half of them with room left, are filled anew; seeded."""
    rng, sizes = random.Random(seed), lengths.tolist()
    held: list[list[int]] = [[] for _ in range(int(bins.max()) + 1 if len(bins) else 0)]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    room = [size - sum(map(sizes.__getitem__, h)) for h in held]
    loose, emptiest = [], 0
    for attempt in range(tries):
        if len(held) <= bound:
            break
        if attempt % 256 == 0:
            loose = [b for b, r in enumerate(room) if r]
            emptiest = max(loose, key=room.__getitem__)
        chosen = {rng.choice(loose) if rng.random() < 0.5 else rng.randrange(len(held)) for _ in range(rng.randint(5, 15))}
        if rng.random() < 0.5:
            chosen.add(emptiest)
        order = sorted(b for b in chosen if b < len(held))
        own, blur = [i for b in order for i in held[b]], rng.random() / 2
        own.sort(key=lambda i: -sizes[i] * (1 - blur * rng.random()))  # noqa: B023
        left, sets = _fullest(own, sizes, size)
        if len(left) > len(order) or (len(left) == len(order) and sum(r * r for r in left) < sum(room[b] ** 2 for b in order)):
            continue
        for b, h, r in zip(order, sets, left, strict=False):
            held[b], room[b] = h, r
        for b in reversed(order[len(left) :]):
            held[b], room[b] = held[-1], room[-1]
            held.pop()
            room.pop()
            loose = [b for b, r in enumerate(room) if r] or [0]
            emptiest = max(loose, key=room.__getitem__)
    out = np.empty(len(lengths), np.int64)
    for b, h in enumerate(held):
        out[h] = b
    return out


def _fullest(own: list[int], sizes: list[int], size: int) -> tuple[list[int], list[list[int]]]:
    """Bins filled one at a time: the first piece left, and of the others the set that fills the bin best. Room left and pieces of each."""
    left, sets = [], []
    while own:
        first, *own = own
        room = size - sizes[first]
        sums, mask, before = 1, (1 << (room + 1)) - 1, []  # bit s: some of the pieces so far have the sum s
        for i in own:
            before.append(sums)
            sums |= (sums << sizes[i]) & mask
            if sums >> room & 1:
                break
        at = sums.bit_length() - 1
        left.append(room - at)
        taken = set()
        for k in range(len(before) - 1, -1, -1):
            if not before[k] >> at & 1:
                taken.add(k)
                at -= sizes[own[k]]
        sets.append([first, *(own[k] for k in sorted(taken))])
        own = [i for k, i in enumerate(own) if k not in taken]
    return left, sets


def places(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Offsets of pieces laid one after another in each bin."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.concatenate([[True], np.diff(bins[order]) > 0])[: len(order)]
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
    out = np.empty(len(lengths), np.int64)
    out[order] = ends - lengths[order] - base
    return out


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing of counts[n] pieces of every length n needs fewer bins: the best of two families of dual feasible functions."""
    n = np.arange(size + 1)
    best = -(-int(counts @ n) // size)
    for k in range(1, size // 2 + 1):  # pieces over size - k fill a bin, those under k count nothing
        f = np.where(n > size - k, size, np.where(n >= k, n, 0))
        best = max(best, -(-int(counts @ f) // size))
    for k in range(1, 101):  # rounding to multiples of 1 / k, in units of 1 / (k * size)
        f = np.where((k + 1) * n % size == 0, n * k, (k + 1) * n // size * size)
        best = max(best, -(-int(counts @ f) // (k * size)))
    return best


def _packer(size: int, base: int, seed: int, tries: int):
    """Packs one partition; bins and bound have its counts once, settled tells which rows are final."""

    def run(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        part = t.column("part")[0].as_py()
        bins, _, fill = best_fit(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        if len(fill) > bound:
            bins = repack(lengths, bins, size, bound, seed + part, tries)
        fill = np.bincount(bins, lengths).astype(np.int64)
        head = np.zeros(len(lengths), np.int64)
        head[np.unique(bins, return_index=True)[1]] = 1
        extra = [bins + ((base + part) << 32), places(lengths, bins), (len(fill) == bound) | (fill[bins] == size), np.where(np.arange(len(lengths)) == 0, bound, 0), head]
        return pa.Table.from_arrays([*(t.column(c) for c in NAMES), *map(pa.array, extra)], names=[*NAMES, "sequence_id", "offset", "settled", "bound", "bins"])

    return run


def pack(docs: DataFrame, encoding: tuple[str, str | None, str | None], size: int = 1024, end: int = 2, part_pieces: int = 200_000, tries: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and the certificate: bins, bound."""
    packed_schema = PIECE + ", uid long, sequence_id long, offset long, settled boolean, bound long, bins long"
    short_batches(docs.sparkSession)
    todo = write_table(pieces(docs, encoding, size, end), "pieces")
    histogram = todo.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for r in histogram:
        counts[r["length"]] += r["count"]
    least, n, done, spent, best, base = lower_bound(counts, size), int(counts.sum()), [], 0, None, 0
    for round_ in count():  # each one saves a bin at least, or is the last
        parts = max(1, -(-n // part_pieces))
        # Random partitions of many documents look alike, so each one's bins fill nearly as well as the whole's.
        dealt = todo.select(*NAMES).withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)))
        packed = write_table(dealt.groupBy("part").applyInArrow(_packer(size, base, round_ << 32, tries), packed_schema), "packed")
        total = packed.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.sum(F.when(~F.col("settled"), F.col("bins"))).alias("open"), F.count(F.when(~F.col("settled"), 1)).alias("n")).first()
        bins = spent + (total["bins"] or 0)
        if best is not None and bins >= best:
            drop(packed)
            break
        if done and best is not None:
            done.pop()
        best = bins
        done += [packed.where("settled"), packed.where("not settled")]
        if bins <= least or not total["n"] or total["bins"] == total["bound"]:
            break
        spent, n, base = bins - total["open"], total["n"], base + parts
        todo = packed.where("not settled")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.lit(best).cast("long").alias("bins"), F.lit(least).cast("long").alias("bound"))
