import random

import pytest
from pyspark.sql import functions as F
from seqloom.operators import kmers, patterns, seeds

SEQ = "id bigint, seq string, pos int"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 9) for i, t in enumerate(texts)], SEQ).select("id", "seq")


# k-mers


@pytest.mark.parametrize("k", [1, 2, 5, 130, 300])
def test_kmers(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ab\né🦆 $") for _ in range(n)) for n in (0, 1, 4, 127, 128, 129, 257, 400, 700)] + [None]
    got = sorted(map(tuple, kmers.kmers(frame(spark, texts), k=k).collect()))
    assert got == sorted((i, p, t[p : p + k]) for i, t in enumerate(texts) if t for p in range(len(t) - k + 1))


def test_postings_and_bad_k(spark):
    df = frame(spark, ["abab", "ab"])
    assert {r.kmer: (r.n, r.positions) for r in kmers.kmer_postings(kmers.kmers(df, k=2)).collect()} == {"ab": (3, [0, 0, 2]), "ba": (1, [1])}
    assert {(r.kmer, r.id): r.positions for r in kmers.kmer_postings(kmers.kmers(df, k=2), True).collect()} == {("ab", 0): [0, 2], ("ba", 0): [1], ("ab", 1): [0]}
    split = kmers.kmer_postings(kmers.kmers(df, k=2), True, width=2)
    assert {(r.kmer, r.id, r.part): (r.n, r.positions) for r in split.collect()} == {("ab", 0, 0): (1, [0]), ("ab", 0, 1): (1, [2]), ("ba", 0, 0): (1, [1]), ("ab", 1, 0): (1, [0])}
    with pytest.raises(ValueError):
        kmers.kmer_postings(kmers.kmers(df, k=2), width=2)
    with pytest.raises(ValueError):
        kmers.kmers(df, k=0)


# seed and extend


def grow(q, r, qp, rp, match=1, mismatch=-1, drop=5):
    """Plain loops over both sides."""
    best, score, right, left = 0, 0, 0, 0
    for i in range(min(len(q) - qp, len(r) - rp)):
        score += match if q[qp + i] == r[rp + i] else mismatch
        if score > best:
            best, right = score, i + 1
        if score < best - drop:
            break
    score = best
    for i in range(1, min(qp, rp) + 1):
        score += match if q[qp - i] == r[rp - i] else mismatch
        if score > best:
            best, left = score, i
        if score < best - drop:
            break
    return qp - left, qp + right, rp - left, rp + right, best


def plain_hits(q, r, k, **scores):
    at = {}
    for p in range(len(r) - k + 1):
        at.setdefault(r[p : p + k], []).append(p)
    return [(qp, rp, *grow(q, r, qp, rp, **scores)) for qp in range(len(q) - k + 1) for rp in at.get(q[qp : qp + k], [])]


# reference, query, k, seeds, distinct hits, best hit
FIXTURES = [
    ("ACGTACGTACGTAAACCCGGGTTTACGTACGT", "ACGTAAACCCGGG", 5, 12, 4, (0, 13, 8, 21, 13)),
    ("ACGTACGTACGTAAACCCGGGTTTACGTACGTCCGGTTAA", "ACGTAAACCCGGG", 5, 12, 4, (0, 13, 8, 21, 13)),
    ("ACGTACGTTAGCTAGCT", "ACGTTAGC", 4, 7, 3, (0, 8, 4, 12, 8)),
    ("ACGTACGTACGT", "ACGT", 3, 6, 3, (0, 4, 0, 4, 4)),
    ("ACGT", "TTTT", 3, 0, 0, None),
]


@pytest.mark.parametrize("ref,query,k,n_seeds,n_hits,best", FIXTURES)
def test_fixture_hits(spark, ref, query, k, n_seeds, n_hits, best):
    q, r = frame(spark, [query]), frame(spark, [ref], 100)
    hits = seeds.seed_extend(q, r, k)
    assert seeds.seed_join(q, r, k).count() == hits.count() == n_seeds
    merged = seeds.seed_extend(q, r, k, dedup=True)
    assert merged.count() == n_hits and (merged.agg(F.sum("n_seeds")).first()[0] or 0) == n_seeds
    top = [(h.query_start, h.query_end, h.ref_start, h.ref_end, h.score) for h in seeds.top_hits(merged, 1).collect()]
    assert top == ([best] if best else [])


@pytest.mark.parametrize("scores", [{}, {"match": 2, "mismatch": -3}, {"match": 0, "mismatch": -1}])
def test_hits_equal_plain_loops(spark, scores):
    rng = random.Random(5)
    long = "".join(rng.choice("acgt") for _ in range(500))
    qs = ["".join(rng.choice("ab") for _ in range(n)) for n in (3, 12, 30)] + [long[100:330] + "x" + long[331:480], "é🦆" * 9]
    rs = ["".join(rng.choice("ab") for _ in range(n)) for n in (2, 25, 60)] + [long, "🦆é" * 12, None]
    got = seeds.seed_extend(frame(spark, qs), frame(spark, rs), 4, **scores).collect()
    have = sorted((h.query_id, h.ref_id, h.query_pos, h.ref_pos, h.query_start, h.query_end, h.ref_start, h.ref_end, h.score) for h in got)
    assert have == sorted((i, j, *h) for i, q in enumerate(qs) for j, r in enumerate(rs) if r for h in plain_hits(q, r, 4, **scores))
    assert all(h.query_seq == qs[h.query_id][h.query_start : h.query_end] and h.ref_seq == rs[h.ref_id][h.ref_start : h.ref_end] for h in got)


def test_growth_over_blocks(spark):
    """Hits over many blocks, and no round has or moves more of a text than a block of it."""
    rng = random.Random(8)
    long = "".join(rng.choice("acgt") for _ in range(5000))
    q, r = frame(spark, [long[700:4300], "acgt"]), frame(spark, ["tt" + long[:2500] + "n" + long[2501:], long[4290:]])
    got = seeds.seed_extend(q, r, 30, dedup=True).collect()
    assert (0, 0, 0, 3600, 702, 4302, 3598) in {(h.query_id, h.ref_id, h.query_start, h.query_end, h.ref_start, h.ref_end, h.score) for h in got}
    name = seeds.addressed(r, r.select("id"), "test")
    held = spark.table(name)
    assert {(b.id, b.no): b.blk for b in held.collect()} == {(i, n): t[n * seeds.STRETCH : (n + 2) * seeds.STRETCH] for i, t in ((0, "tt" + long[:2500] + "n" + long[2501:]), (1, long[4290:])) for n in range(-(-len(t) // seeds.STRETCH))}
    state = spark.range(100).select(F.col("id").alias("ref_id"), (F.col("id") * 100).alias("pos"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seeds._fetched(state, name, "ref_id", F.col("pos"), F.lit(9), "x")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.fixture
def plain_joins(spark, monkeypatch):
    """Shuffled joins only, as on large tables, and nothing re-planned."""
    monkeypatch.setattr(seeds, "BROADCAST_CHARS", 0)
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n in names:
        spark.conf.unset(n)


def test_a_kmer_of_a_third_of_the_texts(spark, plain_joins):
    rng = random.Random(6)
    other = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    qs = [other(30) for _ in range(8)] + ["GGGGGG" + other(5)]
    rs = [("GGGGGG" if i % 3 == 0 else "") + other(12) for i in range(300)] + [qs[0], qs[1][4:]]
    q, r = frame(spark, qs), frame(spark, rs)
    want = sorted((i, j, a, b) for i, x in enumerate(qs) for j, y in enumerate(rs) for a in range(len(x) - 5) for b in range(len(y) - 5) if x[a : a + 6] == y[b : b + 6])
    assert sorted(map(tuple, seeds.seed_join(q, r, 6).collect())) == want
    one, two = (kmers.kmers(t, k=6).withColumnsRenamed({"id": f"{n}_id", "pos": f"{n}_pos"}) for t, n in ((q, "query"), (r, "ref")))
    each, dealt = seeds.salted(one, two, share=100)
    parts = [x["count"] for x in dealt.groupBy("kmer", "salt").count().collect()]
    assert max(parts) <= 2 * two.count() / 100 < dealt.where("kmer = 'GGGGGG'").count()
    assert each.where("kmer = 'GGGGGG'").count() == dealt.where("kmer = 'GGGGGG'").select("salt").distinct().count() > 1


def test_stored_kmers(spark, plain_joins, tmp_path):
    q, r = frame(spark, ["ACGTTAGC", "GGGG", None]), frame(spark, ["ACGTACGTTAGCTAGCT", "GGGGGGGG", "", None])
    seeds.store_kmers(r, "stored_kmers", 4, str(tmp_path / "kmers"))
    try:
        found = seeds.probe(q, "stored_kmers", 4)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, seeds.seed_join(q, r, 4).collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert seeds.probe(q, "stored_kmers", 4, max_occ=2).where("query_id = 1").count() == 0
    finally:
        spark.sql("DROP TABLE stored_kmers")


def test_order_context_and_frequent_kmers(spark):
    q, r = frame(spark, ["ACGTTAGC", "GGGG"]), frame(spark, ["ACGTACGTTAGCTAGCT", "GGGGGGGG"])
    hits = seeds.seed_extend(q, r, 4, dedup=True)
    top = seeds.top_hits(hits, 2).orderBy("query_id", "rank").collect()
    assert [(t.query_id, t["rank"]) for t in top][:2] == [(0, 1), (0, 2)] and top[0].score >= top[1].score
    around = {(h.query_id, h.ref_start): (h.context, h.context_offset) for h in seeds.hit_context(hits, r).collect()}
    assert around[(0, 4)] == ("ACGTACGTTAGCTAGCT", 4)
    assert seeds.seed_join(q, r, 4, max_occ=2).where("query_id = 1").count() == 0 < seeds.seed_join(q, r, 4).where("query_id = 1").count()


# patterns

TEXT = "ACGTACGTACGTTAGCTAGCTAGCT"
SEARCHES = [("ACGTACGTACGT", "ACG", [0, 4, 8]), ("ACGTACGTACGT", "CGT", [1, 5, 9]), ("ACGTACGTACGT", "TAC", [3, 7]), ("ACGTACGTACGT", "XYZ", []), (TEXT, "TAG", [12, 16, 20]), (TEXT, "GCT", [14, 18, 22]), (TEXT, "TAGCT", [12, 16, 20]), ("ACGTACGTTAGCTAGCT", "ACGTTAGC", [4]), ("AAAA", "AA", [0, 1, 2])]


def test_fixture_positions(spark):
    texts = sorted({t for t, _, _ in SEARCHES})
    names = frame(spark, texts)
    found = patterns.pattern_search(names, spark.createDataFrame([(p,) for _, p, _ in SEARCHES], "pattern string"))
    got = {(texts[r.text_id], r.pattern): (r["count"], r.positions) for r in found.collect()}
    assert len(got) == len(texts) * len({p for _, p, _ in SEARCHES})
    for t, p, positions in SEARCHES:
        assert got[(t, p)] == (len(positions), positions)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_positions_equal_plain_scan(spark, monkeypatch, broadcast):
    monkeypatch.setattr(patterns, "BROADCAST_CHARS", broadcast)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab $é🦆") for _ in range(n)) for n in (0, 1, 7, 40, 300, 900)] + ["ab" * 400, None]
    long = texts[5]
    wanted = ["a", "ab", "b $", "é🦆", "ab" * 6, "ab" * 40, "ab" * 140, long, long[3:], long[120:140], long[127:139], long[-12:], long[100:400], long[100:399] + "#", "nowhere", "$", "", None, "a"]
    df, p = frame(spark, texts), spark.createDataFrame([(x,) for x in wanted], "pattern string")
    plain = {(i, x, s) for i, t in enumerate(texts) if t for x in set(wanted) if x for s in range(len(t)) if t.startswith(x, s)}
    assert {tuple(r) for r in patterns.pattern_locate(df, p).collect()} == plain
    assert {(r.text_id, r.pattern, r["count"]) for r in patterns.pattern_count(df, p).collect()} == {(i, x, sum(a == i and b == x for a, b, _ in plain)) for i, x, _ in plain}
    hit = {i for i, _, _ in plain}
    assert {r.id for r in patterns.matched(df, p).collect()} == hit
    assert {r.id for r in patterns.unmatched(df, p).collect()} == set(range(len(texts))) - hit
    assert patterns.pattern_locate(df, p.where("false")).count() == 0


@pytest.mark.parametrize("broadcast,anchor", [(2_000_000, 12), (0, 12), (0, 5), (0, 1), (10**9, 31)])
def test_many_patterns(spark, monkeypatch, broadcast, anchor):
    monkeypatch.setattr(patterns, "BROADCAST_CHARS", broadcast)
    rng = random.Random(anchor)
    texts = ["".join(rng.choice("ACGT") for _ in range(600)) for _ in range(6)]
    wanted = {t[s : s + n] for t in texts for n in (1, 3, 4, 5, 11, 12, 13, 30, 31, 32, 140) for s in rng.sample(range(600 - n), 3)}
    got = patterns.pattern_locate(frame(spark, texts), spark.createDataFrame([(x,) for x in wanted], "pattern string"), anchor)
    plain = sorted((i, x, s) for i, t in enumerate(texts) for x in wanted for s in range(600) if t.startswith(x, s))
    assert sorted(map(tuple, got.collect())) == plain


def test_pattern_plan(spark, tmp_path):
    frame(spark, ["abcdefghijklmnopqrst" * 9] * 50).write.parquet(str(tmp_path / "texts"))
    texts, p = spark.read.parquet(str(tmp_path / "texts")), spark.createDataFrame([("cdefghijklmno",), ("bcd",), ("zz",)], "pattern string")
    plan = patterns.pattern_locate(texts, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("FileScan") == 1 and plan.count("Generate") == 2


def test_fallback_and_context(spark):
    texts = frame(spark, ["xxACGTTAGCyy", "ACGTTAzz", "none"])
    p = spark.createDataFrame([("ACGTTAGC",)], "pattern string")
    got = {(r.text_id, r.searched, r.used_prefix, r["count"], tuple(r.positions)) for r in patterns.search_with_prefix_fallback(texts, p).collect()}
    assert got == {(0, "ACGTTAGC", False, 1, (2,)), (1, "ACGTTA", True, 1, (0,))}
    around = patterns.match_context(patterns.pattern_locate(texts, p), texts, first=True).first()
    assert (around.before, around.match, around.after) == ("xx", "ACGTTAGC", "yy")
