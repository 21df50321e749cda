"""Repacking, exchange and certificates."""

import numpy as np
import pytest

from corpusloom.llm import packing, queries


def test_a_gap_in_one_partition_is_repacked():
    rng = np.random.default_rng(2)
    saved = 0
    for seed in range(12):
        lengths = rng.integers(1, 700, 120)
        bins, _, fill = packing.best_fit(lengths, 1024)
        bound = packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)
        new = packing.repack(lengths, bins, 1024, bound, seed, 3000)
        assert np.bincount(new, lengths).max() <= 1024 and np.array_equal(np.unique(new), np.arange(new.max() + 1)) and bound <= new.max() + 1 <= len(fill)
        assert np.array_equal(new, packing.repack(lengths, bins, 1024, bound, seed, 3000))  # a repeated task makes the same bins
        saved += len(fill) - new.max() - 1
    assert saved > 0


def test_places():
    lengths, bins = np.array([3, 5, 2, 4]), np.array([1, 0, 1, 1])
    assert packing.places(lengths, bins).tolist() == [0, 0, 3, 5] and packing.places(lengths[:0], bins[:0]).tolist() == []


@pytest.mark.parametrize("part_pieces", [40, 10_000])
def test_every_row_has_the_certificate(spark, part_pieces):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('a ', cast(10 + pmod(xxhash64(id), 600) AS int)) AS text")
    p = packing.pack(docs, queries.byte_bpe(), part_pieces=part_pieces, tries=2000).toPandas()
    assert (p["bins"] == p["sequence_id"].nunique()).all()
    assert (p["bound"] == packing.lower_bound(np.bincount(p["length"], minlength=1025), 1024)).all() and (p["bound"] <= p["bins"]).all()
    assert (p.groupby("sequence_id")["length"].sum() <= 1024).all()
    last = p.sort_values("offset").groupby("sequence_id")
    assert (last["offset"].first() == 0).all() and ((last["offset"].last() + last["length"].last()) == last["length"].sum()).all()
