"""Token counts by heap-and-linked-list byte-pair merging.

A text's tokens are counted, never named: symbols at the start minus merges. A symbol is a
character that the vocabulary has as a piece, or one byte of a character that it lacks.
Symbols form a linked list; a heap holds adjacent pairs whose concatenation is a piece, the
lowest rank first and leftmost among equals. Popping a pair joins it, and its new neighbours
go onto the heap.

No piece holds a space mark after another character, so no merge crosses the start of a run
of marks: a text is cut there, and equal segments are counted once a worker as long as the
bounded cache holds them. The vocabulary is read once a worker, from a file that must be
on every machine, as the tokenizer package is.

Defined results: null text counts as empty, empty text has no tokens, repeated rows are
counted one by one, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE = 400_000


class PieceCounter:
    """Counts tokens as the sentencepiece BPE model in ``path`` does, white space marked, with byte fallback and a mark put before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces with inner space marks: segments can't be counted alone")
        self.chars = {p for p in self.rank if len(p) == 1}
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of one segment, by merging."""
        rank, chars = self.rank, self.chars
        symbols: list[str | None] = []
        extra = 0
        for c in text:
            symbols.append(c)
            if c not in chars:
                extra += len(c.encode("utf-8", "surrogatepass")) - 1
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbols[i] + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + symbols[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, i, size + len(symbols[h])))
        return n + extra - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for s in SEGMENT.findall(MARK + text.replace(" ", MARK)):
            n = known.get(s)
            if n is None:
                n = self.merged(s)
                if len(s) <= 64:
                    if len(known) >= CACHE:  # the older half goes
                        for old in list(known)[: CACHE // 2]:
                            del known[old]
                    known[s] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
