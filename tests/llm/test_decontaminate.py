"""Decontamination against a plain version, with one block of tests and with many."""

import brute
import pytest

from corpusloom.llm import decontaminate


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


PASSAGE = " ".join(f"p{k}" for k in range(20, 50))
TESTS = [(1, PASSAGE), (2, "ONE two"), (3, None), (4, "..."), (None, PASSAGE), (5, "w5 w6 w7"), (1, PASSAGE), (6, " ".join(["a"] * 40)), (7, "w199 x x w150 w151 y")]


@pytest.fixture(scope="module")
def few_docs(odd_docs):
    return odd_docs.where("doc_id is null or doc_id <> 9")  # the plain version is slow on its 60,000 words


@pytest.mark.parametrize("more", [{}, {"block_bytes": 60}, {"shard_bytes": 500}, {"block_bytes": 1, "shard_bytes": 100}])
def test_against_a_plain_version(spark, few_docs, more):
    items = spark.createDataFrame(TESTS, "item_id long, text string")
    assert ordered(decontaminate.contamination(few_docs, items, **more).collect()) == ordered(brute.contamination(plain(few_docs), TESTS))


def test_documents_that_stay_keep_all_columns(spark, odd_docs):
    items = spark.createDataFrame(TESTS, "item_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.contamination(odd_docs, items).where("contaminated").collect()}
    for more in ({}, {"block_bytes": 60}):
        kept = decontaminate.remove_contaminated(odd_docs, items, **more)
        assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in plain(odd_docs)} - bad
    assert {7, 8, 10, 11, 12} <= bad and not bad & {2, 4, 5, 9, 13}
    none = decontaminate.contamination(odd_docs, items.limit(0)).collect()
    assert len(none) == odd_docs.count() and not any(r["contaminated"] or r["longest_match"] for r in none)


def test_one_block_at_a_time(spark, few_docs, monkeypatch):
    """Of twenty blocks each is searched and written before the next is sent, and its broadcast is gone by then."""
    live, most, jobs = set(), [], []
    send, write = spark.sparkContext.broadcast, decontaminate.write_table

    def broadcast(value):
        out = send(value)
        live.add(id(out))
        most.append(len(live))
        destroy = out.destroy
        out.destroy = lambda: (live.discard(id(out)), destroy())
        return out

    def written(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        jobs.append((name, plan.count("MapInArrow")))
        return write(df, name)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(decontaminate, "write_table", written)
    items = [(k, f"w{5 * k} w{5 * k + 1} w{5 * k + 2}") for k in range(20)]
    got = decontaminate.contamination(few_docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=1)
    assert max(most) == 1 and len(most) == 20 and [n for name, n in jobs if name == "hits"] == [1] * 20
    assert ordered(got.collect()) == ordered(brute.contamination(plain(few_docs), items))
