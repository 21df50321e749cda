"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing names."""

import hashlib
import random
from pathlib import Path

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from support import SMALL

import corpus_pipeline
from corpusloom.llm import near, packing, quality, queries, suffixes, tokens, units


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("more", [{}, {"leaf": 2, "block": 2}, {"trees": 20, "leaf": 1, "block": 3}])
def test_near(odd_docs, more):
    assert ordered(near.near_components(odd_docs, **more).collect()) == ordered(brute.near_components(plain(odd_docs)))


@pytest.mark.parametrize("more", [{}, {"block_bytes": 3000, "bucket_bytes": 5000}])
def test_suffixes(odd_docs, more):
    assert ordered(suffixes.substring_dedup(odd_docs, **more).collect()) == ordered(brute.substring_dedup(plain(odd_docs)))


def test_suffix_texts_keep_characters_whole(odd_docs):
    out = suffixes.dedup(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == odd_docs.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["text"] is None and by[5]["text"] == "" and by[12]["kept"] == "k"
    assert by[11]["text"].endswith("its end 🙂") and "p30 p31" not in by[11]["text"] and by[12]["text"] == ""


def test_quality(odd_docs):
    rows = quality.quality(odd_docs, weight=1).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0 and by[4]["base_failed"]
    assert by[13]["n_dup_lines"] == 11 and by[13]["base_failed"] and by[14]["n_repeat_words"] == 240
    assert by[1]["n_repeat_words"] == 0 and by[1]["kept"] and by[9]["n_words"] == 60_000
    kept = quality.keep_quality(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").first()["kept"] == "k"


def test_quality_with_many_groups(odd_docs, monkeypatch):
    want = ordered(quality.quality(odd_docs).collect())
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert ordered(quality.quality(odd_docs).collect()) == want


def test_tokens_and_packing(odd_docs):
    n = {r["doc_id"]: r for r in tokens.token_counts(odd_docs, queries.tokenizer_path("piece_bpe_32k.model")).collect()}
    assert n[4]["n_tokens"] == n[5]["n_bytes"] == 0 and n[9]["over_limit"] and not n[7]["over_limit"]
    p = packing.pack(odd_docs, queries.byte_bpe(), part_pieces=20).toPandas()
    assert (p.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert p[p["doc_id"] == 4][["piece", "start", "length"]].values.tolist() == [[0, 0, 1]]
    long_ = p[p["doc_id"] == 9].sort_values("piece")
    assert (long_["length"][1:] == 1024).all() and (long_["start"] == long_["length"].cumsum() - long_["length"]).all()
    g = p.sort_values("offset").groupby("sequence_id")["length"]
    assert (p.sort_values("offset")["offset"] == g.cumsum() - p.sort_values("offset")["length"]).all()


def test_packing_exchanges_until_no_bin_is_saved(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('a ', cast(10 + pmod(xxhash64(id), 20) AS int)) AS text")
    totals, spent, write = [], 0, packing.write_table

    def counted(df, name):
        nonlocal spent
        out = write(df, name)
        if name == "packed":
            bins, final = out.selectExpr("sum(bins)", "coalesce(sum(bins) FILTER (WHERE settled), 0)").first()
            totals.append(spent + bins)
            spent += final
        return out

    monkeypatch.setattr(packing, "write_table", counted)
    p = packing.pack(docs, queries.byte_bpe(), size=64, part_pieces=20, tries=0).toPandas()  # exchange alone
    assert len(totals) > 4 and totals[-1] == totals[-2] == p["sequence_id"].nunique() < totals[3]
    assert len(p) == 6000 and (p.groupby("sequence_id")["length"].sum() <= 64).all()
    assert packing.pack(docs, queries.byte_bpe(), size=64, part_pieces=20, tries=2000).first()["bins"] < totals[-1]  # repacking saves more


def test_empty_tables(odd_docs):
    none = odd_docs.limit(0)
    for f in (near.near_components, suffixes.substring_dedup, quality.quality, units.removed_units, lambda d: packing.pack(d, queries.byte_bpe()), lambda d: tokens.token_counts(d, queries.tokenizer_path("piece_bpe_32k.model"))):
        assert f(none).count() == 0


def test_every_stage_takes_odd_and_empty_tables(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            out.collect()


def test_one_of_each_group_stays(odd_docs):
    out = near.one_of_each(odd_docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids and out.columns == odd_docs.columns


def test_block_sizes_keep_the_number_of_notes_in_proportion():
    notes = lambda total: (total / suffixes.side(total)) ** 2
    for total in (2 << 30, 8 << 30, 30 << 30):
        assert 0.9 < notes(2 * total) / notes(total) / 2 < 1.1
    assert suffixes.side(1) == 2 << 20 and suffixes.side(1e15) == 32 << 20


def test_stored_blocks_have_small_rows_and_row_groups(spark):
    noise = random.Random(5).randbytes(1_500_000).hex()
    rows = [(1, noise), (2, noise[1000:900_000] + "x"), (3, None), (4, "start " + noise[2_000_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = suffixes._stored(suffixes._blocks(docs.coalesce(1), 32 << 20), 2)
    binary = [c for c, kind in stored.dtypes if kind == "binary"]
    assert stored.select(F.max(F.greatest(F.lit(0), *[F.octet_length(c) for c in binary]))).first()[0] <= 128 << 10
    files = [pq.ParquetFile(p).metadata for p in Path(stored.stored_at.removeprefix("file:")).glob("*.parquet")]
    sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(sizes) > 2 << 20 and max(sizes) < 5 << 18
    got = {r["doc_id"]: r for r in suffixes.substring_dedup(docs).collect()}
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    gone = [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in (got[k] for k in range(1, 5))]
    assert gone == [(3_000_000, 0, 0), (899_001, 899_000, 1), (0, 0, 0), (1_000_006, 1_000_000, 1)]
    assert got[2]["kept_sha256"] == hashlib.sha256(b"x").hexdigest() and got[4]["kept_sha256"] == hashlib.sha256(b"start ").hexdigest()
