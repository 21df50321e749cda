"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from support import SMALL, rows_of

from corpusloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert rows and all(abs(r["in_norm"] - 1) < 1e-5 and abs(r["out_norm"] - 1) < 1e-5 for r in rows)


def test_negatives_are_distinct_words_of_the_owner(spark):
    from corpusloom import queries as q

    stored = q._vocab(spark, SMALL)
    pairs = q.G.document_pairs(q._docs(spark, SMALL), stored, q.WINDOW)
    rows = q.S.negative_samples(pairs, stored, q.CONFIG.negative_samples, q.CONFIG.seed).toPandas()
    vocab = QUERIES["vocab_global_index"](spark, SMALL).toPandas()
    owner = dict(zip(vocab["global_idx"], vocab["owner"], strict=True))
    number = {(o, i): g for o, i, g in zip(vocab["owner"], vocab["local_idx"], vocab["global_idx"], strict=True)}
    assert not rows.duplicated(["out_idx", "in_idx", "local_idx"]).any()
    for out, in_, local in zip(rows["out_idx"], rows["in_idx"], rows["local_idx"], strict=True):
        assert number[owner[out], local] not in (out, in_)


def test_text_of_odd_numbers_matches_sql(spark, duck, tmp_path):
    """Negative numbers that are rounded to zero, halves, what isn't a number, and vectors without numbers."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    ties = [s * (2 * k + 1) / 128 for k in range(64) for s in (1, -1)]  # exact halves of the sixth decimal
    vectors = [[-4.9e-7, 4.9e-7, -5.1e-7, -0.0, 0.0, -1e-30], ties, [float("nan"), float("inf"), -float("inf"), None, 0.5], [], None, [1e6, -123456.789, 8388607.5]]
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    sql = SQL["embedding_text_format"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")
    got = QUERIES["embedding_text_format"](spark, str(tmp_path)).collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in duck.execute(sql).fetchall())
