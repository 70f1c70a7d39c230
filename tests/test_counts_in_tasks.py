"""Postings and character tables that the task of a text makes."""

import random

import pytest
from seqloom.operators import kmers, suffix

SEQ = "id bigint, seq string"


def frame(spark, again):
    rng = random.Random(4)
    texts = ["", "a", "é🦆 b$"] + ["".join(rng.choice("ab é🦆") for _ in range(n)) for n in (9, 10, 11, 300)] + [None]
    return spark.createDataFrame([*enumerate(texts), *([(3, "abab"), (None, "ab"), (None, "ab")] if again else [])], SEQ)


@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("k", [1, 2, 7])
def test_postings_without_a_shuffle(spark, k, again):
    """every place of every text was shuffled to its k-mer's row."""
    df = frame(spark, again)
    got = kmers.text_postings(df, k=k, width=10)
    want = kmers.kmer_postings(kmers.kmers(df, k=k), True, 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.select(*got.columns).collect()), key=str)
    assert again or "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("again", [False, True])
def test_char_table_by_both_routes(spark, again):
    """F8: one task's map had the characters of all the texts of a file."""
    df = frame(spark, again)
    rows = [r for r in df.collect() if r.seq is not None]
    want = []
    for i in {r.id for r in rows}:
        s = "".join(r.seq if r.seq.endswith("$") else r.seq + "$" for r in rows if r.id == i)
        want += [(i, c, s.count(c), sum(x < c for x in s)) for c in set(s)]
    for short in (suffix.SHORT, 10):
        assert sorted(map(tuple, suffix.char_table(df, short).collect()), key=str) == sorted(want, key=str)
    assert again or "Aggregate" not in suffix.char_table(df)._jdf.queryExecution().executedPlan().toString()
