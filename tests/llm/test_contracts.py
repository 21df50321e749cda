"""Every query against its SQL or a plain version, on the smallest tables."""

import zlib
from pathlib import Path

import brute
import numpy as np
import pytest
from support import SMALL, rows_of

from corpusloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_quality_rules", "op6_near_dedup", "op8_suffix_array_dedup"])
def test_matches_sql_on_odd_documents(odd_docs, tmp_path, name):
    """Nulls, blanks, long texts and ties, with other columns of clashing names; doc_ids once each, as SQL takes them."""
    import duckdb

    docs = odd_docs.where("doc_id is not null and doc_id <> 9").dropDuplicates(["doc_id"]).cache()
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.queries()[name](docs.sparkSession, str(tmp_path)).toPandas(), con.execute(SQL[name]).fetch_df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_near_dedup(spark, duck):
    got = [tuple(r) for r in queries.op6_near_dedup(spark, SMALL).collect()]
    assert sorted(got) == sorted(brute.near_components(documents(duck)))


def test_suffix_array_dedup(spark, duck):
    got = [tuple(r) for r in queries.op8_suffix_array_dedup(spark, SMALL).collect()]
    assert sorted(got) == sorted(brute.substring_dedup(documents(duck)))


def test_token_counts(spark, duck):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op3_token_counts(spark, SMALL).collect()}
    want = {d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in documents(duck)}
    assert got == want


def test_packing(spark, duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = queries.op7_packing(spark, SMALL).toPandas()
    want = {}
    for d, text in documents(duck):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        n, cuts = len(ids), [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k] = (i, j - i, zlib.crc32(ids[i:j].tobytes()))
        assert n == cuts[-1]
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 1024
    from corpusloom.llm.packing import lower_bound

    least = lower_bound(np.bincount(got["length"], minlength=1025), 1024)
    assert got["sequence_id"].nunique() <= least * 1.01 + 1


def test_html_of_the_pages(spark):
    rows = queries.op9_html_extraction(spark, SMALL).collect()
    assert rows and all(r["text"] and "track(" not in r["text"] and "<p" not in r["text"] for r in rows)


def test_pipeline(spark, duck):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in list(stages.items())[:-1]:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        assert seen[-1].columns == docs.columns, name
        assert 0 < seen[-1].count() <= seen[-2].count()
    kept = {r["doc_id"] for r in queries.op5_quality_rules(spark, SMALL).where("kept").collect()}
    assert {r["doc_id"] for r in seen[1].collect()} == kept
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    assert {r["doc_id"] for r in seen[2].collect()} == {d for d, _, _, k in brute.near_components(plain(seen[1])) if k}
    want = {r[0]: r for r in brute.substring_dedup(plain(seen[2]))}
    for r in seen[3].collect():
        assert len(r["text"].encode()) <= want[r["doc_id"]][1] - want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])
    bad = {d for d, _, _, _, _, c, *_ in brute.contamination(plain(seen[3]), duck.execute("SELECT * FROM benchmark").fetchall()) if c}
    assert {r["doc_id"] for r in seen[4].collect()} == {d for d, _ in plain(seen[3])} - bad
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed["doc_id"]) == {d for d, _ in plain(seen[4])}


def test_nothing_else_imports_the_subpackage():
    root = Path(queries.__file__).parents[2]
    for p in (root / "corpusloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "corpusloom.llm" not in p.read_text(), p
