"""A Merkle manifest of a dataset in Van Emde Boas layout, and proofs from it.

Rows are leaves, in an order of their own in each group; ``arity`` 2: every two consecutive nodes
become their digest, a lone last one too while others remain, up to the group's subroot. The subroots,
ordered by group, become the root in the same way.

The tree is stored as aligned subtrees, the blocks: 2^HEIGHT neighbouring leaves with all nodes above
them, up to one block root, in one binary value per block. The block roots of a level are the leaves of the next one,
and so on until a group has one block. Inside a block nodes lie in Van Emde Boas order: the top half of
the heights first, as a subtree of its own, then the subtrees below it from left to right, each
split at half its height again. ``addresses`` is that arithmetic; building a block writes nodes
through it and fetching siblings reads them through it, so that a path of n nodes lies in few
stretches of the value whatever the size of a cache line or page is.

Work in Spark: leaf digests are built-in functions in the scan; (group, doc_id, leaf) is range-sorted, and local
numbers with offsets by range and group give ranks, so a group with a third of all rows is spread over
a third of the ranges; blocks are groups of 2^HEIGHT rows, whatever the groups' sizes. Every level is written to the
shared folder and has 2^HEIGHT times fewer rows than the one below it. Proofs go down again: a block gets the
siblings above its root from the level above by an equi-join on (group, block), and adds its own.

Defined results
- null fields are ``-`` in a leaf, others their length in UTF-8 bytes, a colon and the value, so no two rows
  of different values have one leaf; text and names may hold anything;
- rows are ordered by doc_id, null first, then by leaf; rows equal in all of the fields are neighbours;
- null group: a group of its own, before all others, which are in the order of their UTF-8 bytes;
- a group of one row: its leaf is the subroot; one group: its subroot is the root; a lone leaf that is the root
  has an empty proof; an empty table gives an empty result;
- other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, partitions

HEIGHT = 10  # of a block: 1,024 leaves
SIZE = 32  # bytes of a digest


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """A row's digest, in hexadecimal."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """By depth from the root of a complete tree of ``height``: the place of each node in Van Emde Boas order."""

    def at(levels: int, depth: int, p: np.ndarray) -> np.ndarray:
        if levels == 1:
            return np.zeros_like(p)
        top = levels // 2
        if depth < top:
            return at(top, depth, p)
        below, inner = levels - top, depth - top
        # behind the top come the lower subtrees, each of 2^below - 1 nodes
        return (1 << top) - 1 + (p >> inner) * ((1 << below) - 1) + at(below, inner, p & ((1 << inner) - 1))

    return tuple(at(height + 1, d, np.arange(1 << d)) for d in range(height + 1))


def height_of(n: int, alone: bool, height: int) -> int:
    """The height of a block of ``n`` leaves: the full one where a level has several blocks, else the least that holds them."""
    return (n - 1).bit_length() if alone else height


def built(leaves: list[bytes], height: int) -> bytes:
    """A block's nodes in order of their addresses; places without a node are zero."""
    at = addresses(height)
    nodes = np.zeros(((2 << height) - 1, SIZE), dtype=np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[at[depth][: len(level)]] = np.frombuffer(b"".join(level), dtype=np.uint8).reshape(-1, SIZE)
        if depth:
            level = [joined(level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes.tobytes()


def siblings(nodes: bytes, n: int, height: int, place: int) -> list[tuple[bytes, bool]]:
    """(digest, whether it lies left) of the siblings of leaf ``place`` of ``n``, upwards; ``b""`` for a lone node."""
    at, found = addresses(height), []
    for depth in range(height, 0, -1):
        other = place ^ 1
        lo = int(at[depth][other]) * SIZE
        found.append((nodes[lo : lo + SIZE] if other < n else b"", other < place))
        place, n = place >> 1, (n + 1) >> 1
    return found


def _packed(path: list[tuple[bytes, bool]]) -> bytes:
    """A path as bytes: per level a mark (0 lone, 1 left, 2 right) and the sibling."""
    return b"".join(bytes([0 if not d else 1 if left else 2]) + d for d, left in path)


def _unpacked(raw: bytes) -> list[tuple[bytes, bool]]:
    path, i = [], 0
    while i < len(raw):
        n = SIZE if raw[i] else 0
        path.append((raw[i + 1 : i + 1 + n], raw[i] == 1))
        i += 1 + n
    return path


# Spark. A level is a table (g, block, n, alone, nodes): group number, block's number in it, leaves, whether it is the group's only block.


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group with their number in the group inside the partition."""
    group, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g").to_pylist()
        new = np.flatnonzero(np.array([g[i] != g[i - 1] for i in range(1, len(g))], dtype=bool)) + 1
        number = np.empty(len(g), dtype=np.int64)
        for lo, hi in zip([0, *new], [*new, len(g)], strict=True):
            if count == 0 or g[lo] != group:
                group, count = g[lo], 0
            number[lo:hi] = np.arange(count, count + hi - lo)
            count += hi - lo
        yield b.append_column("number", pa.array(number))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (g, doc_id, digest, ...) with ``rank``, their place in their group by doc_id, null first, and digest.

    Rows equal in these are told apart by a number, so that no value fills a range of its own.
    """
    spark = rows.sparkSession
    light = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")
    order = [F.col("g").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = light.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*ranged.dtypes, ("number", "bigint")])
    local = materialize(ranged.mapInArrow(_numbered, kinds), "merkle-order")
    discard(light)
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    shifts = local.groupBy("g", "part").agg(F.count("*").alias("n")).select(F.col("g").alias("_g"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s"))
    placed = local.join(shifts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
    return placed.withColumn("rank", F.col("number") + F.col("_s")).drop("_g", "_p", "_s", "number", "part")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        leaves, alone, wide = (b.column(c).to_pylist() for c in ("leaves", "alone", "height"))
        heights = [height_of(len(x), a, h) for x, a, h in zip(leaves, alone, wide, strict=True)]
        nodes = [built(x, h) for x, h in zip(leaves, heights, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("g"), b.column("block"), pa.array([len(x) for x in leaves], pa.int32()), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), pa.array([x[:SIZE] for x in nodes], pa.binary())],
            ["g", "block", "n", "height", "nodes", "top"],
        )


def level(leaves: DataFrame, height: int) -> DataFrame:
    """(g, block, n, height, nodes, top): the blocks over ``leaves`` (g, rank, digest), one binary value each."""
    blocks = leaves.groupBy("g", F.shiftright("rank", height).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("leaves"))
    most = blocks.groupBy("g").agg(F.max("block").alias("most")).withColumnRenamed("g", "_g")
    told = blocks.join(most, F.col("g").eqNullSafe(F.col("_g"))).select("g", "block", F.transform("leaves", lambda x: x["digest"]).alias("leaves"), (F.col("most") == 0).alias("alone"), F.lit(height).alias("height"))
    return materialize(told.mapInArrow(_build, f"g {leaves.schema['g'].dataType.simpleString()}, block bigint, n int, height int, nodes binary, top binary"), "merkle-level")


def levels(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """All levels over ``leaves`` (g, rank, digest), lowest first; the last has one block per group."""
    found = [level(leaves, height)]
    while not found[-1].where("block > 0").isEmpty():
        # groups that are done have their root as a tree of one leaf above it
        found.append(level(found[-1].select("g", F.col("block").alias("rank"), F.col("top").alias("digest")), height))
    return found


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gs, blocks, ups = [], [], []
        for g, block, n, h, nodes, up, wide in zip(*(b.column(c).to_pylist() for c in ("g", "block", "n", "height", "nodes", "up", "wide")), strict=True):
            for place in range(n):
                gs.append(g)
                blocks.append((block << wide) + place)
                ups.append(_packed(siblings(nodes, n, h, place)) + up)
        yield pa.RecordBatch.from_arrays([pa.array(gs, b.schema.field("g").type), pa.array(blocks, pa.int64()), pa.array(ups, pa.binary())], ["g", "block", "up"])


def paths_to_blocks(found: list[DataFrame], up: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(g, block, up) of the lowest level: siblings from each block's root upwards, given those of the groups' roots (g, up)."""
    above = up.withColumn("block", F.lit(0).cast("bigint"))
    for upper in reversed(found[1:]):
        held = _with_up(upper, above).withColumn("wide", F.lit(height))
        above = materialize(held.select("g", "block", "n", "height", "nodes", "up", "wide").mapInArrow(_down, f"g {upper.schema['g'].dataType.simpleString()}, block bigint, up binary"), "merkle-up")
    return above


def _with_up(blocks: DataFrame, up: DataFrame) -> DataFrame:
    told = up.select(F.col("g").alias("_g"), F.col("block").alias("_b"), "up")
    return blocks.join(told, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, digests, lefts, ends = [], [], [], [0]
        for members, n, h, nodes, up in zip(*(b.column(c).to_pylist() for c in ("rows", "n", "height", "nodes", "up")), strict=True):
            ends_at = len(up) - 2 * SIZE
            above, subroot, root = _unpacked(up[:ends_at]), up[ends_at:-SIZE].hex(), up[-SIZE:].hex()
            above = [(d.hex(), left) for d, left in above]
            for place, r in enumerate(members):
                path = [(d.hex(), left) for d, left in siblings(nodes, n, h, place)] + above
                digests.extend(d for d, _ in path)
                lefts.extend(left for _, left in path)
                ends.append(len(digests))
                rows.append((r["doc_id"], r["digest"].hex(), r["changed"] and r["changed"].hex(), subroot, root))
        path = pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(lefts, pa.bool_())], ["digest", "left"])
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), *[pa.string()] * 4])]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), path)], ["doc_id", "leaf", "changed", "subroot", "root", "siblings"])


class Manifest(NamedTuple):
    """A written manifest.

    ``rows`` (g, rank, doc_id, digest, changed) are the leaves in order, ``trees`` the levels of blocks over them,
    and ``groups`` (g, subroot, root, up) has a row per group with the packed siblings of its subroot.
    """

    rows: DataFrame
    trees: list[DataFrame]
    groups: DataFrame
    height: int


def build(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", changed: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Write the manifest of ``docs``: a leaf per row of ``fields``, a tree per ``group``, a tree over those.

    ``changed``: a row's leaf, in hexadecimal, as it will be presented for a check where that is not the stored one; else null.
    """
    none = F.lit(None).cast("string")
    leaves = docs.select(F.col(group).cast("string").alias("g"), F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(leaf(*[F.col(c) for c in fields])).alias("digest"), F.unhex(none if changed is None else changed).alias("changed"))
    rows = materialize(ranked(leaves), "merkle-ranks")
    trees = levels(rows.select("g", "rank", "digest"), height)
    # the last level's block of a group holds its subroot; groups are in the order of their bytes, null first
    tops = materialize(ranked(trees[-1].select(F.lit(0).alias("g"), F.col("g").alias("doc_id"), F.col("top").alias("digest"))), "merkle-tops")
    crown = levels(tops.select("g", "rank", "digest"), height)
    root = crown[-1].select("g", F.col("top").alias("root"))  # one row, or none
    above = paths_to_blocks(crown, crown[-1].select("g", F.unhex(F.lit("")).alias("up")), height)
    first = _with_up(crown[0], above).withColumn("wide", F.lit(height)).select("g", "block", "n", "height", "nodes", "up", "wide")
    ups = first.mapInArrow(_down, "g int, block bigint, up binary").withColumnRenamed("block", "rank")
    groups = tops.join(ups, ["g", "rank"]).join(root, "g").select(F.col("doc_id").alias("g"), F.col("digest").alias("subroot"), "root", "up")
    groups = materialize(groups, "merkle-groups")
    for t in (tops, *crown):
        discard(t)
    return Manifest(rows, trees, groups, height)


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, siblings) per row; siblings (digest, left) lead from the leaf to the root.

    A lone node's sibling is an empty digest. What is the same for all of a block's leaves comes to the block
    as one value: the siblings above it, subroot and root.
    """
    height = manifest.height
    up = manifest.groups.select("g", F.concat("up", "subroot", "root").alias("up"))
    below = _with_up(manifest.trees[0], paths_to_blocks(manifest.trees, up, height))
    members = manifest.rows.groupBy(F.col("g").alias("_g"), F.shiftright("rank", height).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "digest", "changed"))).alias("rows"))
    held = below.join(members, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
    columns = "doc_id bigint, leaf string, changed string, subroot string, root string, siblings array<struct<digest:string,left:boolean>>"
    return held.select("rows", "n", "height", "nodes", "up").mapInArrow(_prove, columns)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, both in hexadecimal."""
    step = lambda h, s: F.sha2(F.when(s["left"], F.concat(s["digest"], h)).otherwise(F.concat(h, s["digest"])).cast("binary"), 256)
    return F.aggregate(path, start, step)


def verified(proved: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``proofs``: each row's presented leaf, folded with its stored siblings, against the root."""
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["digest"]), "").cast("binary"), 256)
    told = proved.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("siblings")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
