"""Stored k-mers as runs that share a minimizer."""

import random

import pytest
from seqloom.operators import kmers, seeds

SEQ = "id bigint, seq string"


@pytest.mark.parametrize("k", [1, 4, 11])
def test_runs_hold_each_kmer_once(spark, monkeypatch, tmp_path, k):
    """the stored table had a row for every place of every text."""
    monkeypatch.setattr(seeds, "LARGE", 64)
    rng = random.Random(k)
    refs = ["".join(rng.choice("abé🦆") for _ in range(n)) for n in (0, 1, 12, 63, 64, 65, 400)] + ["a" * 90, None]
    r = spark.createDataFrame(list(enumerate(refs)), SEQ)
    runs = seeds.kmer_runs(r, k).collect()
    got = sorted((x.ref_id, x.ref_pos + i, x.piece[i : i + k]) for x in runs for i in range(len(x.piece) - k + 1))
    assert got == sorted(map(tuple, kmers.kmers(r, k=k).collect()))
    assert k < 11 or len(runs) < len(got) / 2
    q = spark.createDataFrame([(1, refs[6][5:40] + "a" * 12), (2, refs[3])], SEQ)
    seeds.store_kmers(r, f"runs_{k}", k, str(tmp_path / "runs"))
    want = sorted(map(tuple, seeds.seed_join(q, r, k).collect()))
    assert sorted(map(tuple, seeds.probe(q, f"runs_{k}", k).collect())) == want
    monkeypatch.setattr(seeds, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, seeds.probe(q, f"runs_{k}", k).collect())) == want
    spark.sql(f"DROP TABLE runs_{k}")
