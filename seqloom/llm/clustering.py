"""Centroid clustering of vectors by Lloyd's rounds, with Orchard's search for the nearest centroid.

Orchard: each centroid has a list of all others by their distance from it. A vector starts at
a centroid and walks its list; a centroid found closer takes over, and the walk goes on from the start of
that one's list. Centroids measured once are marked and not measured again. Where
the list's next entry lies strictly beyond twice the vector's distance from its centroid, no
later entry can be as near, so the walk ends. Components are integers and distances squared, so all of
this is exact: "beyond twice" is d2(c, c') > 4 * d2(x, c), and of centroids at one distance the smaller number wins.

A round is one pass over the stored vectors: tasks search by batches of Arrow rows, each a step of all
its vectors at a time, and give back one row per centroid with the count and the componentwise sums of
their vectors; those rows are added by centroid. To the driver come ``k`` rows of ``dim`` numbers
a round, both parameters. A cluster that holds a third of all vectors is summed in the tasks first.

Defined results
- vectors of another length than ``dim``, null, or with null or non-finite components are left out, as are
  those with a component of 2^17 or more in magnitude, whose squared distances need not fit 64 bits;
- vec_ids are ids of rows: nulls and repeats are rows of their own; a null one is taken as first
  centroid only where others are too few; repeats by their components;
- fewer vectors than ``k``: as many centroids; none: an empty result;
- a centroid without vectors stays where it is; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize

LIMIT = 1 << 27  # a component's magnitude, scaled
STEP = 2048  # vectors that are searched side by side


def quantized(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>): usable vectors, each component floor(scale * x)."""
    x = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * scale))
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT)
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.size("embedding") == dim)
    return held.where(F.forall("embedding", usable)).select("vec_id", x.cast("array<int>").alias("v"))


def first_centroids(held: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest SHA-256 of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = held.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


class Orchard:
    """The search structure over ``centroids``: neighbours by distance, and that distance."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        apart = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        np.fill_diagonal(apart, -1)  # itself first, and never walked to
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many distances were measured."""
        n, k = len(x), len(self.centroids)
        best = np.zeros(n, dtype=np.int64)
        d = ((x - self.centroids[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        at = np.zeros(n, dtype=np.int64)  # the place in the list of ``best``
        going, measured = np.arange(n), n
        while k > 1 and len(going):
            own = best[going]
            going = going[self.apart[own, at[going]] <= 4 * d[going]]
            if not len(going):
                break
            c = self.order[best[going], at[going]]
            at[going] += 1
            new = ~seen[going, c]
            i, c = going[new], c[new]
            seen[i, c] = True
            far = ((x[i] - self.centroids[c]) ** 2).sum(axis=1)
            measured += len(i)
            closer = (far < d[i]) | ((far == d[i]) & (c < best[i]))
            i = i[closer]
            best[i], d[i], at[i] = c[closer], far[closer], 0
            going = going[at[going] < k - 1]
        return best, d, measured


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, STEP):
            yield b.slice(lo, STEP)


def summed(held: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By centroid number: the count of its vectors and their componentwise sums."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Orchard(centroids), np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in _steps(batches):
            x = _vectors(b.column("v"))
            own, _, _ = search.nearest(x)
            np.add.at(total, own, x)
            count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"c": some.astype(np.int32), "n": count[some], "s": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = held.select("v").mapInArrow(run, "c int, n bigint, s array<bigint>")
    # sums of sums may leave 64 bits
    wide = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")) for j in range(dim)]).alias("s"))
    return {r["c"]: (r["n"], [int(s) for s in r["s"]]) for r in wide.collect()}


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in _steps(batches):
            own, d, _ = search.nearest(_vectors(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def centroid_digest(centroid: np.ndarray) -> str:
    """SHA-256 of the components as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    held = materialize(quantized(vectors, dim, scale), "vectors")
    centroids = first_centroids(held, k, seed)
    columns = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns)
    for _ in range(rounds):
        for c, (n, s) in summed(held, centroids).items():
            centroids[c] = [x // n for x in s]
    found = materialize(assigned(held, centroids), "assigned")
    discard(held)
    per = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = spark.createDataFrame([(c, per.get(c, 0), sum(per.values()), centroid_digest(centroids[c])) for c in range(len(centroids))], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
