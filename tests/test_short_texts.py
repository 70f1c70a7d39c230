"""Rotations of texts that one task ranks, without joins or broadcasts."""

import random

from seqloom.operators import align, suffix

SEQ = "id bigint, seq string"


def frame(spark, seed=3):
    rng = random.Random(seed)
    texts = ["", "a$a$", "é🦆 b", "ab" * 700, "x" * 900] + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 600))) for _ in range(20)] + [None]
    return [t if t.endswith("$") else t + "$" for t in texts if t is not None], spark.createDataFrame(list(enumerate(texts)), SEQ)


def orders(texts):
    return [[i for _, i in sorted((s[i:] + s[:i], i) for i in range(len(s)))] for s in texts]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bwt_has_no_join(spark):
    """many short texts went to the driver as a broadcast of all their characters."""
    texts, df = frame(spark)
    got = suffix.bwt_blocks(df)
    assert "Join" not in plan(got) and "Broadcast" not in plan(got)
    assert {r.text_id: r.bwt for r in suffix.bwt(df).collect()} == {n: "".join(s[i - 1] for i in o) for n, (s, o) in enumerate(zip(texts, orders(texts), strict=True))}


def test_orders_by_both_routes(spark):
    """ranks of texts of some hundred characters went by rounds of shuffles."""
    texts, df = frame(spark)
    want = {(n, part, tuple(o[part * 100 : part * 100 + 100])) for n, o in enumerate(orders(texts)) for part in range(-(-len(o) // 100))}
    for short in (suffix.SHORT, 50):
        assert {(r.text_id, r.part, tuple(r.indexes)) for r in suffix.rotation_orders(df, 100, short).collect()} == want
    assert "Join" not in plan(suffix.rotation_ranks(df)) and "Window" not in plan(suffix.rotation_ranks(df))


def test_blocks_by_both_routes(spark):
    """the blocks of texts that one task ranks need no shuffle but that which deals texts out."""
    texts, df = frame(spark)
    full = ["".join(s[i - 1] for i in o) for s, o in zip(texts, orders(texts), strict=True)]
    want = {(n, part, s[part * 100 : part * 100 + 100]) for n, s in enumerate(full) for part in range(-(-len(s) // 100))}
    for short in (suffix.SHORT, 50):
        assert {tuple(r) for r in suffix.bwt_blocks(df, short, size=100).collect()} == want
    assert "hashpartitioning" not in plan(suffix.bwt_blocks(df, size=100))


def test_pairs_meet_without_broadcast(spark):
    """rows by deletions of many texts went to the driver as a broadcast; copies were compared each on its own."""
    names = [f"Customer#{n:06d}" for n in range(30)] * 3
    df = spark.createDataFrame(list(enumerate(names)), SEQ)
    found = align.global_score_pairs(df, df, 27, 2, -1, -2)
    assert "Broadcast" not in plan(found)
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert sorted(map(tuple, found.collect())) == sorted((i, j, 30 - 3 * apart(a, b)) for i, a in enumerate(names) for j, b in enumerate(names) if apart(a, b) <= 1)
