import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from seqloom.llm import mixing

DOCS = "doc_id bigint, text string, source string, size int, target string, n_chars bigint"


def targets(sizes):
    """Rounds of sharing by weight and capping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction([5, 2, 1][i % 3]) for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        s = rng.choice(["a", "b", "b", "b", "b", "C", "é", None, "tiny" if i % 50 == 0 else "b"])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), s, 1, "x", 0))
    return [*rows, (300, None, "nothing", 1, "x", 0), (301, "", None, 1, "x", 0), (7, "a b", "b", 1, "x", 0), (7, "a b", "b", 1, "x", 0)]


def test_targets_and_cuts(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), abs=1e-6)
    for s in sizes:
        assert taken[s] == round(want[s]) or abs(taken[s] - want[s]) <= 0.5
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len(sizes))


def test_reruns_agree(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    key = lambda d: sorted((r.doc_id, r["size"], r.taken) for r in d.collect())
    assert key(mixing.mix(df)) == key(mixing.mix(df.repartition(7)))


def test_stage(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    words = out.groupBy("doc_id", "source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    want = mixing.mix(df).where("taken > 0").groupBy("doc_id", "source").agg(F.max("taken").alias("n"))
    left = {(r.doc_id, r.source): r.n for r in words.collect() if r.doc_id != 7}
    assert left == {(r.doc_id, r.source): r.n for r in want.collect() if r.doc_id != 7}
    assert out.where(F.char_length("text") != F.col("n_chars")).count() == 0


def brute_force(df):
    """The words that each row takes by the plain rule, in the order of the rows' hashes."""
    size, sizes, rows = mixing.word_count(F.col("text")), {}, []
    for r in df.select("*", *[c.alias(f"_{n}") for n, c in mixing._order_columns(df, size, 17).items()]).collect():
        rows.append(r)
        sizes[r.source] = sizes.get(r.source, 0) + r["_size"]
    want, before, taken = targets(sizes), {}, []
    for r in sorted(rows, key=lambda r: (r["_key"], r["_doc_id"] is not None, r["_doc_id"] or 0, r["_size"], r["_tie"])):
        at = before.setdefault(r.source, 0)
        before[r.source] += r["_size"]
        epochs, rest = divmod(int(want[r.source] + want[r.source].__class__(1) / 2), sizes[r.source]) if sizes[r.source] else (0, 0)
        taken.append((r, epochs * r["_size"] + max(0, min(r["_size"], rest - at))))
    return taken


def rows_with_repeats():
    """Null doc_ids, rows of one doc_id and size, and rows that are alike in all that orders them."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), " ".join([f"w{i}"] * rng.choice([3, 3, 50])), rng.choice(["a", "b", "b", "b", None]), i, "x", 0) for i in range(200)]
    return rows + [(None, "same text", "b", i, "x", 0) for i in range(200, 204)] + [(None, None, "a", 204, "x", 0)] + [(5, "one two three four five", "c", i, "x", 0) for i in range(205, 265)]


def test_taken_by_the_plain_rule(spark):
    for rows in (rows_with_repeats(), corpus()):
        df = spark.createDataFrame(rows, DOCS)
        got = sorted(((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(df).collect()), key=str)
        assert got == sorted(((r.doc_id, r.source, r["_size"], n) for r, n in brute_force(df)), key=str)


def test_stage_keeps_each_row(spark):
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, DOCS)
    alike = lambda i: "same" if 200 <= i < 204 else "cut" if i >= 205 else i
    want = sorted(((alike(r["size"]), n) for r, n in brute_force(df) if n), key=str)
    assert any(k == "cut" and 0 < n % 5 for k, n in want) or sum(k == "cut" for k, n in want) < 60
    for d in (df, df.repartition(7)):
        words = mixing.word_count(F.col("text"))
        got = mixing.apply_mix(d).groupBy("size").agg(F.sum(words).alias("n")).collect()
        assert sorted(((alike(r["size"]), r.n) for r in got), key=str) == want


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n\nc  d ",)], "t string")
    assert [df.select(mixing.first_words(F.col("t"), F.lit(n))).first()[0] for n in (1, 2, 3, 4, 9)] == ["  a", "  a b", "  a b\n\nc", "  a b\n\nc  d", "  a b\n\nc  d "]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.apply_mix(df).count() == 0


BIG = [(None, 5), (2**53 + 1, 4), (2**53 + 3, 3), (2**53 + 5, 6), (1, 2)]


@pytest.mark.parametrize("share", [0.5, 0.75, 1.0, 2.0])
def test_large_ids_beside_null(spark, share):
    rows = [(i, " ".join(f"w{i}" for _ in range(n)), s, 1, "x", 0) for s in ("a", None) for i, n in BIG]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    mixed = mixing.mix(df, share=share).collect()
    assert sorted(r.doc_id or 0 for r in mixed) == sorted(2 * [i or 0 for i, _ in BIG])
    words = {}
    for r in mixing.apply_mix(df, share=share).collect():
        words[r.source, r.doc_id] = words.get((r.source, r.doc_id), 0) + len(r.text.split())
    assert words == {(r.source, r.doc_id): r.taken for r in mixed if r.taken}
