"""Places of texts that are looked up by hash among few k-mers or patterns."""

import random

import pytest
from seqloom.operators import kmers, patterns

SEQ = "id bigint, seq string"


@pytest.mark.parametrize("k", [1, 5, 20])
def test_kmers_among(spark, monkeypatch, k):
    """every place of every text was a row before it met the few queries' k-mers."""
    monkeypatch.setattr(kmers, "LARGE", 64)
    rng = random.Random(k)
    texts = ["".join(rng.choice("abé🦆") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 200, 700)] + [None]
    wanted = [t[i : i + k] for t in texts if t for i in range(0, len(t) - k + 1, 37)] + ["z" * k]
    df, w = spark.createDataFrame(list(enumerate(texts)), SEQ), spark.createDataFrame([(x,) for x in wanted], "kmer string")
    got = sorted(map(tuple, kmers.kmers_among(df, w, k=k).collect()))
    assert got == sorted((i, p, t[p : p + k]) for i, t in enumerate(texts) if t for p in range(len(t) - k + 1) if t[p : p + k] in set(wanted))


def test_search_shuffles_no_pairs(spark):
    """F15 (and the step of F10, F11): texts x patterns went through a join by text and pattern."""
    texts = spark.createDataFrame([(1, "abcab"), (2, "xx"), (3, None), (1, "xx")], SEQ)
    found = patterns.pattern_search(texts, spark.createDataFrame([("ab",), ("x",), ("q",)], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text_id" not in plan or "pattern" not in plan.split("hashpartitioning(text_id")[-1].split(")")[0]
    got = sorted((r.text_id, r.pattern, r["count"], tuple(r.positions)) for r in found.collect())
    one = [(1, "ab", 2, (0, 3)), (1, "q", 0, ()), (1, "x", 2, (0, 1))]
    assert got == sorted([*one, *one, (2, "ab", 0, ()), (2, "q", 0, ()), (2, "x", 2, (0, 1)), (3, "ab", 0, ()), (3, "q", 0, ()), (3, "x", 0, ())])
