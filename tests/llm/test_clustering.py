import hashlib
import math
import random

import numpy as np
import pytest
from seqloom.llm import clustering

VECTORS = "vec_id bigint, embedding array<float>, label int, v int, c string"


def lloyd(rows, k, rounds, dim, seed=3):
    """By the plain rule, with Python's integers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1 << 17 for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, c in found if c == n) for n in range(len(centroids))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), told[c]) for i, d, c in found), key=str)


@pytest.mark.parametrize("n,k,dim", [(150, 8, 4), (60, 20, 2), (5, 8, 3), (40, 1, 3), (90, 7, 1)])
def test_equals_plain_lloyd(spark, n, k, dim):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.choice([rng.uniform(-1, 1), 0.0, 0.5, -0.25]))) for _ in range(dim)]) for i in range(n)]
    rows += [(2**53 + 1, [0.25] * dim), (2**53 + 3, [0.25] * dim), (None, [0.0] * dim), (None, [1e5] * dim), (3, [-0.5] * dim)]
    rows += [(900, None), (901, []), (902, [0.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("-inf")] * dim), (905, [None] * dim), (906, [3e38] * dim)]
    df = spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], VECTORS).repartition(3)
    got = clustering.cluster(df, k=k, rounds=4, dim=dim).collect()
    assert sorted(map(tuple, got), key=str) == lloyd(rows, k, 4, dim)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1, 2, "x")], VECTORS)
    assert clustering.cluster(df).count() == 0 == clustering.cluster(df.where("false")).count()


@pytest.mark.parametrize("seed", range(6))
def test_orchard_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    k, dim = int(rng.integers(1, 60)), int(rng.integers(1, 5))
    centres = rng.integers(-9, 9, (k, dim)) * int(rng.integers(1, 1000))
    x = rng.integers(-9, 9, (500, dim)) * int(rng.integers(1, 1000))
    d2 = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    best, d, measured = clustering.Orchard(centres).nearest(x)
    assert (best == d2.argmin(axis=1)).all() and (d == d2.min(axis=1)).all() and measured <= 500 * k


def test_orchard_measures_few_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5000, (100, 3)).astype(np.int64)
    x = centres[rng.integers(0, 100, 2000)] + rng.integers(-50, 50, (2000, 3))
    assert clustering.Orchard(centres).nearest(x)[2] < 2000 * 25
