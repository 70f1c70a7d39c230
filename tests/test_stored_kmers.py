"""Stored k-mers as packed runs."""

import random
from collections import Counter
from pathlib import Path

import pytest
from seqloom.operators import kmers, seeds


def words(rng, n):
    known = ["".join(rng.choice("abcdefghijklmnopéñ") for _ in range(rng.randint(2, 9))) for _ in range(4_000)]
    return " ".join(rng.choice(known) for _ in range(n // 6))


def test_stored_bytes(spark, tmp_path):
    """a run was a row of a shuffle, and one of a table with 4 to 5 bytes for a character of text."""
    rng = random.Random(1)
    texts = [words(rng, 60_000) for _ in range(16)]
    r = spark.createDataFrame(list(enumerate(texts)), "id bigint, seq string").repartition(4)
    seeds.store_kmers(r, "bytes_11", 11, str(tmp_path / "bytes"))
    try:
        size = sum(f.stat().st_size for f in Path(tmp_path / "bytes").rglob("*.parquet"))
        assert size < 3 * sum(map(len, texts))
        assert sorted(map(tuple, seeds.probe(r.limit(0), "bytes_11", 11).collect())) == []
    finally:
        spark.sql("DROP TABLE bytes_11")
    rows = seeds._packed_runs(r, 11, seeds._bucket_keys(spark, 4))
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [seeds.BROADCAST_CHARS, 0])
def test_probe_of_many_rows(spark, monkeypatch, tmp_path, broadcast):
    """seeds are those of a join of k-mers, whatever the ids, however rows are cut, and with no k-mer met."""
    for name, value in {"HELD": 900, "ROW": 300, "LARGE": 100, "BROADCAST_CHARS": broadcast}.items():
        monkeypatch.setattr(seeds, name, value)
    rng = random.Random(2)
    texts = [words(rng, n) for n in (30, 700, 2_000)] + ["a" * 1_500, "🦆é" * 60, "", "short", None, "ab" * 20]
    r = spark.createDataFrame([(f"r{i % 8}", t) for i, t in enumerate(texts)], "id string, seq string")
    q = spark.createDataFrame([(1, texts[2][90:140]), (2, "a" * 14), (5, "xé🦆é🦆é🦆é🦆é🦆éx"), (3, "ZZZZZZZZZZZZZZZZ"), (None, texts[1][:40]), (4, "ab" * 8)], "id bigint, seq string")
    one, two = (kmers.kmers(t, k=11).collect() for t in (q, r))
    want = sorted(((a.id, b.id, a.pos, b.pos) for a in one for b in two if a.kmer == b.kmer), key=str)
    seeds.store_kmers(r, f"many_{broadcast}", 11, str(tmp_path / "many"))
    seeds.store_kmers(r.where("seq is null"), f"none_{broadcast}", 11, str(tmp_path / "none"))
    try:
        got = lambda *a, **b: sorted(map(tuple, seeds.probe(*a, **b).collect()), key=str)
        assert got(q, f"many_{broadcast}") == want and len(want) > 1_000
        n = Counter(b.kmer for b in two)
        rare = {(a.id, a.pos) for a in one if n[a.kmer] <= 3}
        assert got(q, f"many_{broadcast}", max_occ=3) == [x for x in want if (x[0], x[2]) in rare]
        assert got(q.where("id = 3"), f"many_{broadcast}") == got(q, f"none_{broadcast}") == got(q, f"many_{broadcast}", k=10) == []
    finally:
        for name in ("many", "none"):
            spark.sql(f"DROP TABLE {name}_{broadcast}")

