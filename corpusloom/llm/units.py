"""Substring deduplication by hashing lines or paragraphs, and where asked for the sentences in them.

Every unit of every text is normalised (A-Z lower-cased, runs of blanks made one space, ends
stripped) and digested. Digests are grouped over the whole corpus; of equal ones the occurrence ranked first
by (doc_id, row, start) stays, and the others are removed. What is removed keeps its place in the original
text: number of its unit, start and length in code points.

``sentences`` is an extension beside the method: passages are also copied into the midst of lines, so a unit of several
sentences has a digest for each of them too. ``found_by`` tells which of the two removes something: an
earlier equal line (or paragraph), or only an equal sentence.

Every unit and sentence that isn't blank is digested, in any script. ``min_words`` and ``min_sentence``
leave out those of fewer words, cut at blanks; a line of a script without blanks is one word.

Rows are numbered once, in a written table, so repeated doc_ids stay apart however later reads are split.

Defined results: null or empty text has no units; a null doc_id ranks first; repeated rows are
documents of their own, later ones lose their units; an empty table gives no rows. dedup_units() keeps all other
columns; one named ``removed`` gives way to its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, short_batches, write_table

CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
#: Consecutive sentences, each with the marks that end it.
SENTENCE = re.compile(r"[.!?]*[^.!?]+[.!?]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
UNITS = "doc_id long, row long, unit int, sentence boolean, start long, length long, digest binary"
NAMES = ["doc_id", "row", "unit", "sentence", "start", "length", "digest"]


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in CUTS[unit].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def normalise(text: str) -> str:
    return _BLANKS.sub(" ", text.translate(_LOWER)).strip(" ")


def _digests(text: str, unit: str, min_words: int, sentences: bool, min_sentence: int) -> Iterator[tuple[int, bool, int, int, bytes]]:
    """unit, sentence, start, length, digest of all that can be a duplicate in a text."""
    for k, (i, j) in enumerate(spans(text, unit)):
        parts = [(False, i, j)]
        if sentences:
            inner = list(SENTENCE.finditer(text, i, j))
            if len(inner) > 1:
                parts += [(True, *m.span()) for m in inner]
        for sentence, a, b in parts:
            n = normalise(text[a:b])
            if n and n.count(" ") + 1 >= (min_sentence if sentence else min_words):
                yield k, sentence, a, b - a, hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def units(numbered: DataFrame, unit: str, min_words: int, sentences: bool, min_sentence: int) -> DataFrame:
    """The units of documents (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(doc, row, *x) for x in _digests(text or "", unit, min_words, sentences, min_sentence)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], NAMES)

    return numbered.select("doc_id", "row", "text").mapInArrow(run, UNITS)


def _removed(numbered: DataFrame, unit: str, min_words: int, sentences: bool, min_sentence: int) -> DataFrame:
    all_units = write_table(units(numbered, unit, min_words, sentences, min_sentence), "units")
    place = F.struct("doc_id", "row", "start", "sentence")
    # Partial minima first: a digest that a third of all rows has reaches its reducer as a row a task.
    first = all_units.groupBy("digest").agg(F.min(place).alias("kept"), F.min(F.when(~F.col("sentence"), place)).alias("kept_unit"), F.count("*").alias("n")).where("n > 1")
    first = write_table(first, "first-units")
    gone = join_hot(all_units, first, "digest", "n", all_units.count()).where(place != F.col("kept"))
    by = F.when(~F.col("sentence") & (F.col("kept_unit") < place), unit).otherwise("sentence")
    whole = F.min("sentence").over(W.partitionBy("row", "unit"))
    gone = gone.withColumns({"whole": ~whole, "found_by": by}).where(~F.col("sentence") | ~F.col("whole"))
    return gone.select("doc_id", "row", "unit", "sentence", "start", "length", "found_by", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text", *more)


def removed_units(docs: DataFrame, unit: str = "line", min_words: int = 1, sentences: bool = False, min_sentence: int = 1) -> DataFrame:
    """doc_id, row, unit, sentence, start, length, found_by of all that is removed, and kept_doc_id, kept_start of what stays for it.

    ``row`` tells documents of one doc_id apart. Sentences of a removed unit aren't listed.
    """
    short_batches(docs.sparkSession)
    return _removed(_numbered(docs), unit, min_words, sentences, min_sentence)


def without_units(text: str, gone: list[tuple[int, int]], unit: str) -> str:
    """What is left of a text: removed units go with their breaks, removed sentences out of their units."""
    out, k = [], 0
    for i, j in spans(text, unit):
        left, at = [], i
        while k < len(gone) and gone[k][0] < j:
            left.append(text[at : gone[k][0]])
            at, k = gone[k][0] + gone[k][1], k + 1
        if at > i or not left:
            left.append(text[at:j])
        kept = "".join(left)
        if kept or i == j:
            out.append(kept)
    return ("\n" if unit == "line" else "\n\n").join(out)


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = 1, sentences: bool = False, min_sentence: int = 1) -> DataFrame:
    """The documents with all their columns, text without its removed units, and ``removed``, the original (start, length) of each."""
    short_batches(docs.sparkSession)
    rest = [F.col(c) for c in docs.columns if c not in ("text", "removed")]
    stored = write_table(_numbered(docs, F.struct(*rest).alias("doc")), "unit-texts")
    gone = _removed(stored, unit, min_words, sentences, min_sentence)
    lists = gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("removed"))
    joined = stored.select("row", "text", "doc").join(lists, "row", "left").select("doc", "text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                without_units(t, [(s["start"], s["length"]) for s in r], unit) if t is not None and r else t
                for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], ["doc", "text", "removed"])

    out = joined.mapInArrow(cut, joined.schema)
    return out.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c != "removed"], "removed")
