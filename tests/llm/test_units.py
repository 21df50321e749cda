"""Lines, paragraphs and sentences that repeat, against a plain version and on hand-made texts."""

import brute
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import units


@pytest.mark.parametrize("sentences", [False, True])
@pytest.mark.parametrize(("unit", "cut"), [("line", r"\n"), ("paragraph", r"\n[ \t]*\n\s*")])
def test_against_a_plain_version(spark, odd_docs, unit, cut, sentences):
    docs = odd_docs.dropDuplicates(["doc_id"]).unionByName(odd_docs.where("doc_id = 11").withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit("One.  Two!\n\nA  line that\trepeats itself here\n \n\nonE. two\n\nLast one. TWO! x")}))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = units.removed_units(docs, unit, sentences=sentences).collect()
    key = lambda x: tuple((y is not None, y or 0) for y in x)
    assert sorted(((r["doc_id"], r["unit"], r["sentence"], r["start"], r["length"], r["found_by"] == unit) for r in got), key=key) == sorted(brute.removed_units(rows, cut, sentences), key=key)


def test_all_columns_stay_and_repeated_ids_stay_apart(odd_docs):
    out = units.dedup_units(odd_docs.withColumn("removed", F.lit(1)))
    assert out.columns == [*odd_docs.columns, "removed"] and out.count() == odd_docs.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[13]["text"] == "a line that repeats itself here" and by[4]["text"] is None and by[2]["text"] == "" and by[1]["removed"] is None
    assert by[1]["kept"] == "k" and sorted(r["text"] for r in out.where("doc_id = 12").collect()) == ["", brute_passage()]
    assert units.dedup_units(odd_docs.limit(0)).count() == 0


def brute_passage() -> str:
    return " ".join(f"p{k}" for k in range(70))


def test_numbers_stay_when_the_reads_are_split_otherwise(spark, monkeypatch):
    """Each read of a written table is split in its own way, as when executors come and go."""
    texts = {k: f"own line {k}\nshared line\nanother own {k}" for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    key, write, sizes = "spark.sql.files.maxPartitionBytes", units.write_table, iter(["2k", "128m", "700", "64m", "1k"] * 4)
    before = spark.conf.get(key)

    def written(df, name):
        out = write(df, name)
        spark.conf.set(key, next(sizes))
        return out

    monkeypatch.setattr(units, "write_table", written)
    try:
        out = {r["doc_id"]: r["text"] for r in units.dedup_units(docs).collect()}
    finally:
        spark.conf.set(key, before)
    assert out == {k: t if k == 0 else t.replace("shared line\n", "") for k, t in texts.items()}


def test_a_passage_inside_a_line(spark):
    inner = "This is a passage that several documents share word by word. It goes on for another sentence of enough words too."
    docs = spark.createDataFrame([(1, f"One begins so. {inner} Ends."), (2, f"Two is another.\nHere begins a line. {inner} And more!"), (3, "Nothing shared here, all these words are on their own.")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in units.dedup_units(docs, sentences=True).collect()}
    assert out == {1: f"One begins so. {inner} Ends.", 2: "Two is another.\nHere begins a line. And more!", 3: "Nothing shared here, all these words are on their own."}
    assert units.removed_units(docs).count() == 0


def test_short_lines_and_lines_without_blanks(spark):
    zh = "这一行没有空格也是重复的内容"
    docs = spark.createDataFrame([(1, f"Read more\n{zh}\nfirst"), (2, f"READ  more\nsecond\n{zh}"), (3, "Third here. So it goes. Its end"), (4, "Fourth there. So it goes. Another end")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in units.dedup_units(docs, sentences=True).collect()}
    assert out == {1: f"Read more\n{zh}\nfirst", 2: "second", 3: "Third here. So it goes. Its end", 4: "Fourth there. Another end"}
