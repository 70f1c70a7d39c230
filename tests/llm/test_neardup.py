import itertools
import random

import pytest
from seqloom.llm import neardup

DOCS = "doc_id bigint, text string, source string, u bigint, component_id bigint"  # extra columns with clashing names


def brute(docs, k, percent):
    """Smallest reachable id and set size per id, over all pairs."""
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(neardup.shingle_set(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (max(map(len, sets[i])), find(i)) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 80]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((n, rng.choice([" ", "\n", "\t "]).join(own)))
            n += 1
    # a chain whose ends are far apart, and edge cases
    long = [f"c{i}" for i in range(100)]
    for step in range(12):
        docs.append((n + step, " ".join(long[step * 4 :] + [f"d{step}x{i}" for i in range(step * 4)])))
    n += 12
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "One two"), (n + 5, "One two"), (n + 6, "x " * 5000)]
    return docs


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k=k).collect()}
    assert got == brute(docs, k, 80)


def test_links_that_no_centre_sees(spark):
    """The centre of every bucket is far from two members that are near each other."""
    base = [f"w{i}" for i in range(400)]
    centre = base[:]
    a = base[:30] + [f"a{i}" for i in range(60)] + base[90:]
    b = a[:-6] + [f"b{i}" for i in range(6)]
    docs = [(1, " ".join(centre)), (2, " ".join(a)), (3, " ".join(b))]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, k=2, bands=200, rows=1).collect()}
    assert got == {i: r for i, (_, r) in brute(docs, 2, 80).items()} == {1: 1, 2: 2, 3: 2}


def test_hashes_tell_shingles_apart():
    text = "Aa bB\x0bc aa bb C d é"
    assert len(neardup.shingle_hashes(text, 2)) == len(neardup.shingle_set(text, 2))
    assert (neardup.shingle_hashes("a b c", 2) == neardup.shingle_hashes("\tA  b\nC ", 2)).all()
    assert len(neardup.shingle_hashes(None, 2)) == len(neardup.shingle_hashes(" ", 2)) == 0
    assert neardup.shingle_hashes("ab c", 2)[0] != neardup.shingle_hashes("a bc", 2)[0]


def test_stage_keeps_one_of_each_group(spark):
    rows = [(2, "a b c d e f g", "s", 1, 2), (1, "a b c d e f g", "s", 1, 2), (1, "a b c d e f g", "s", 1, 2), (3, None, "s", 1, 2), (None, "a b c d e f g", "s", 1, 2), (4, "h i j k l m", "s", 1, 2)]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (3, ""), (4, "h i j k l m")]
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
