import hashlib
import random

import pytest
from pyspark.sql import functions as F
from seqloom.llm import fingerprint as fp

DOCS = "doc_id bigint, text string, bucket string, row int, id int"


def edited(rows):
    """(doc_id, n_chars, sha256) by the plain rule."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        m = len(t) // 4
        e = t[: len(t) - m] + rows[(n + 1) % len(rows)][1][:m]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return out


def paragraphs(t):
    return {line[i : i + fp.PIECE] for line in (t or "").split("\n") if line.strip(" ") for i in range(0, len(line), fp.PIECE)}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(5)
    pool = [f"line {i} é🦆" * rng.randint(1, 20) for i in range(300)]
    rows = [(i * 7 % 101, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 30, 200])))) for i in range(80)]
    return [*rows, (500, None), (501, ""), (502, " \n \n"), (503, rows[0][1]), (504, rows[0][1]), (504, rows[0][1]), (None, "null id"), (-4, "a\nb\n" * 3)]


def test_query_equals_plain_rule(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], DOCS).repartition(3)
    got = fp.edit_fingerprints(df).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(edited(rows), key=str)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        m = len(t) // 4
        want.setdefault(i, []).append((round(jaccard(t, t[: len(t) - m] + following[:m]), 9), round(jaccard(t, following), 9)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((round(r.near_edited, 9), round(r.near_next, 9)))
    assert {i: sorted(v) for i, v in have.items()} == {i: sorted(v) for i, v in want.items()}
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[503] == prints[504] == prints[0] != prints[501] == prints[500] == ""


def test_peeling_recovers_digests(spark):
    a, b = list(range(1000, 1300)), list(range(1010, 1305))
    rows = spark.createDataFrame([(1, x, s) for s, xs in ((1, a), (-1, b)) for x in xs], "k int, digest bigint, s int")
    left, right = (fp.sketch_cells(rows.where(F.col("s") == s).select("k", "digest"), ["k"], 96) for s in (1, -1))
    peeled = fp.peel(fp.subtract(left, right, ["k"]), ["k"], 96).where("abs(side) = 1").collect()
    assert {(r.digest, r.side) for r in peeled} == {(x, 1) for x in range(1000, 1010)} | {(x, -1) for x in range(1300, 1305)}


def test_too_small_a_sketch_is_retried(spark):
    pairs = spark.createDataFrame([(1, "x", list(range(400)), list(range(300, 900))), (2, "x", [], []), (3, "x", [5], [])], "k int, kind string, a array<bigint>, b array<bigint>")
    got = {r.k: (sorted(r.left), sorted(r.right), r.likeness) for r in fp.likeness(pairs, ["k", "kind"], cells=96).collect()}
    assert got == {1: (list(range(300)), list(range(400, 900)), pytest.approx(100 / 900)), 2: ([], [], 1.0), 3: ([5], [], 0.0)}


def test_query_recovers_the_differing_digests(spark):
    rows = corpus()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edits = [t[: len(t) - len(t) // 4] + ordered[(n + 1) % len(ordered)][1][: len(t) // 4] for n, (_, t) in enumerate(ordered)]
    pieces = sorted({p for _, t in ordered for p in paragraphs(t)} | {p for t in edits for p in paragraphs(t)})
    hashed = {r.p: r.h for r in spark.createDataFrame([(p,) for p in pieces], "p string").select("p", F.xxhash64("p").alias("h")).collect()}

    def told(a, b):
        a, b = ({hashed[p] for p in paragraphs(t)} for t in (a, b))
        return hashlib.sha256("|".join(",".join(map(str, sorted(x))) for x in (a - b, b - a)).encode()).hexdigest()

    want = sorted((str(i), told(t, e), told(t, ordered[(n + 1) % len(ordered)][1])) for n, ((i, t), e) in enumerate(zip(ordered, edits, strict=True)))
    got = fp.edit_fingerprints(spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.recovered_edited_sha256, r.recovered_next_sha256) for r in got) == want


def test_edges(spark):
    one = fp.edit_fingerprints(spark.createDataFrame([(1, "abcdefgh", "b", 1, 2)], DOCS)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.edit_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_text_is_of_the_sketch(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-(2**63), 2**63) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 40, 500))]
    df = spark.createDataFrame(rows, "k int, d array<bigint>")
    cells = {}
    for r in fp.sketch_cells(df.select("k", F.explode("d").alias("digest")), ["k"], 96).where("cell >= 0").collect():
        cells.setdefault(r.k, []).append((r.cell, f"{r.cell}:{r.n}:{r.x % 2**64:x}:{r.c % 2**64:x}".lower()))
    want = {i: " ".join(t for _, t in sorted(cells.get(i, []))) for i, _ in rows}
    pad = lambda t: " ".join(":".join(p.lstrip("0") or "0" if n > 1 else p for n, p in enumerate(c.split(":"))) for c in t.split(" ")) if t else ""
    got = {r.k: r.f for r in df.select("k", fp.fingerprint_text(F.col("d"), 96).alias("f")).collect()}
    assert {i: pad(t) for i, t in got.items()} == {i: pad(t) for i, t in want.items()}
