"""Partitions, chunks, tokens and counts on hand-made inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as TX
from corpusloom.operators import counts
from corpusloom.sources import corpus, embeddings
from corpusloom.streaming.word_counts import stream_counts


def pattern(n: int) -> bytes:
    return (b"a aa aaa " * (n // 9 + 1))[:n]


@pytest.mark.parametrize(
    ("size", "parts", "want"),
    [(100, 2, [(0, 53), (53, 47)]), (133, 2, [(0, 67), (67, 66)]), (100, 3, [(0, 35), (35, 36), (71, 29)]), (133, 3, [(0, 44), (44, 45), (89, 44)])],
)
def test_byte_ranges(tmp_path, size, parts, want):
    p = tmp_path / "c.txt"
    p.write_bytes(pattern(size))
    assert corpus.byte_ranges(str(p), parts) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé \n\tß", max_size=200), st.integers(1, 6), st.integers(1, 50))
def test_ranges_and_chunks_lose_nothing(tmp_path_factory, text, parts, size):
    p = tmp_path_factory.mktemp("c") / "c.txt"
    p.write_bytes(text.encode())
    ranges = corpus.byte_ranges(str(p), parts)
    assert sum(n for _, n in ranges) == len(text.encode())
    assert "".join(t for a, n in ranges for t in corpus.whole_words(corpus.chunks(str(p), a, n, size))) == text


@pytest.mark.parametrize("cut", ["\t", "\n", " "])
def test_word_count(spark, cut):
    text = cut.join("Der Fluß floß, der Mond schien und Der Fluß rauschte".split(" "))
    got = {r["word"]: r["cnt"] for r in counts.word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {"der": 3, "fluß": 2, "floß,": 1, "mond": 1, "schien": 1, "und": 1, "rauschte": 1}


def test_nulls_blanks_and_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t\x0b\f\r\n "), (4, "a  b")], "doc_id long, text string")
    assert [tuple(r) for r in counts.tokens(docs).collect()] == [(4, 0, "a"), (4, 1, "b")]
    assert {r["doc_id"]: r["n_tokens"] for r in counts.doc_token_counts(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 2}
    assert counts.word_counts(docs.limit(0)).count() == 0


def test_delimiters(spark):
    df = spark.createDataFrame([("ab c\td",), ("abc",), (" ",)], "t string")
    assert [tuple(r) for r in df.select(TX.first_delimiter(F.col("t")), TX.last_delimiter(F.col("t"))).collect()] == [(2, 4), (-1, 3), (0, 0)]


def test_text_corpus_keeps_order(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one two\nthree\n")
    rows = corpus.read_text(spark, str(tmp_path / "t.txt")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["one two", "three"]


def test_embedding_lines(spark, tmp_path):
    w = spark.createDataFrame([("satz", [0.5, -0.25]), ("ein", [1.0, 0.0])], "word string, in_w array<double>")
    assert embeddings.lines(w).first()[0] == "satz 0.5000000000 -0.2500000000"
    for _ in range(2):  # an earlier result is replaced
        embeddings.write_text(w, str(tmp_path / "out"), single_file=True)
    back = embeddings.read_text(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("ein", [1.0, 0.0]), ("satz", [0.5, -0.25])]


def test_a_stream_of_one_file_leaves_its_neighbours_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, text in (("d.parquet", "a b a"), ("d.parquet2", "x"), ("d.parquet.bak", "y"), ("d[1].parquet", "z")):
        pq.write_table(pa.table({"doc_id": [1], "text": [text]}), str(tmp_path / name))
    count = lambda p: {r["word"]: r["cnt"] for r in stream_counts(spark, str(tmp_path / p)).collect()}
    assert count("d.parquet") == {"a": 2, "b": 1} and count("d[1].parquet") == {"z": 1}
    spark.createDataFrame([(1, "a"), (2, "c")], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "folder.parquet"))
    assert count("folder.parquet") == {"a": 1, "c": 1}


def test_a_reader_of_words_begins_anew(tmp_path):
    text = "Ein Satz\tmit  Wörtern\n" * 50
    (tmp_path / "c.txt").write_bytes(text.encode())
    want = text.lower().split()
    reader = corpus.WordReader(str(tmp_path / "c.txt"), size=37)
    assert reader.progress() == 0
    first = [next(reader) for _ in range(30)]
    assert first == want[:30] and 0 < reader.progress() < 1
    reader.reset()
    assert reader.progress() == 0 and list(reader) == want and reader.progress() == 1
    parts = corpus.byte_ranges(str(tmp_path / "c.txt"), 3)
    assert [w for a, n in parts for w in corpus.WordReader(str(tmp_path / "c.txt"), a, n, 20)] == want
    (tmp_path / "none.txt").write_text("")
    assert list(corpus.WordReader(str(tmp_path / "none.txt"))) == [] and corpus.WordReader(str(tmp_path / "none.txt")).progress() == 1
