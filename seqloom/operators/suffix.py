"""Suffix order of texts: rotation ranks, Burrows-Wheeler transform, character tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import character_counts, cut, rotation_order, slices, spelt
from ..sources.tables import by_repeats, discard, materialize, partitions
from .kmers import blocks, spread_out, substrings

SHORT = 1 << 18  # characters of a text up to which one task sorts its rotations
PART = 4096  # ranks of a text to a row on their way from there
FIRST = 12  # characters of the first ranks


def closed(texts: DataFrame) -> DataFrame:
    """(text_id, seq): texts (id, seq) that end in ``$``, added only where it is missing; nulls are left out."""
    ended = F.when(F.endswith("seq", F.lit("$")), F.col("seq")).otherwise(F.concat("seq", F.lit("$")))
    return texts.where("seq is not null").select(F.col("id").alias("text_id"), ended.alias("seq"))


def characters(ended: DataFrame) -> DataFrame:
    """(text_id, i, ch, n) of closed texts."""
    return ended.select("text_id", F.char_length("seq").cast("bigint").alias("n"), F.posexplode(F.split("seq", "")).alias("i", "ch")).where("i < n").select("text_id", F.col("i").cast("bigint").alias("i"), "ch", "n")


def _by_text(ended: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], columns: str) -> DataFrame:
    """(text_id, ``columns``): what ``work`` makes of the texts of a slice, their code points and where each begins."""
    id_type = ended.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, codes, starts in slices(b, "seq"):
                yield work(rows, codes, starts)

    return spread_out(ended).mapInArrow(run, f"text_id {id_type}, {columns}")


def _runs(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, begin): the places of each text in parts of ``size``, and with the last part's end where each begins."""
    parts = -(-np.diff(starts) // size)
    row = np.repeat(np.arange(len(parts)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    return row, part, np.append(starts[row] + part * size, starts[-1])


def _ordered_parts(size: int):
    def work(rows: pa.RecordBatch, codes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        row, part, begin = _runs(starts, size)
        index = rotation_order(codes, starts) - np.repeat(starts[:-1], np.diff(starts))
        return pa.RecordBatch.from_arrays([rows.column("text_id").take(pa.array(row)), pa.array(part), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(index))], ["text_id", "part", "indexes"])

    return work


def _transformed_parts(size: int):
    def work(rows: pa.RecordBatch, codes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        row, part, begin = _runs(starts, size)
        order, first = rotation_order(codes, starts), np.repeat(starts[:-1], np.diff(starts))
        last = codes[np.where(order > first, order - 1, first + np.repeat(np.diff(starts), np.diff(starts)) - 1)]
        return pa.RecordBatch.from_arrays([rows.column("text_id").take(pa.array(row)), pa.array(part), pa.array([spelt(last[lo:hi]) for lo, hi in zip(begin[:-1], begin[1:], strict=True)], pa.string())], ["text_id", "block", "bwt"])

    return work


def _brief_and_long(texts: DataFrame, short: int) -> tuple[DataFrame, DataFrame | None]:
    """Closed texts of up to ``short`` characters, and the longer ones, if there are any."""
    ended = closed(texts)
    long = ended.where(F.char_length("seq") > short)
    return ended.where(F.char_length("seq") <= short), None if long.isEmpty() else long


def rotation_orders(texts: DataFrame, size: int, short: int = SHORT) -> DataFrame:
    """(text_id, part, indexes): the rotations' indexes in the order of ``rotation_ranks``, those of ``size`` ranks to a row."""
    brief, long = _brief_and_long(texts, short)
    found = _by_text(brief, _ordered_parts(size), "part bigint, indexes array<bigint>")
    if long is None:
        return found
    part = F.floor(F.col("rank") / size).cast("bigint").alias("part")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "i"))), lambda x: x["i"])
    return found.unionByName(_doubled(long).groupBy("text_id", part).agg(listed.alias("indexes")))


def rotation_ranks(texts: DataFrame, short: int = SHORT) -> DataFrame:
    """(text_id, i, rank): the place of each rotation among all of its text, equal ones by index.

    A text is a row, so ids should not repeat. The rotations of texts up to ``short`` characters are sorted in the task
    that has the text, of many texts at once; longer ones double a prefix rank in rounds of
    their own (rank by the first h characters, then 2h), about log2 of the longest repeat / FIRST.
    """
    brief, long = _brief_and_long(texts, short)
    orders = _by_text(brief, _ordered_parts(PART), "part bigint, indexes array<bigint>")
    direct = orders.select("text_id", "part", F.posexplode("indexes").alias("at", "i")).select("text_id", "i", (F.col("part") * PART + F.col("at")).alias("rank"))
    return direct if long is None else direct.unionByName(_doubled(long))


def _beginnings(ended: DataFrame) -> DataFrame:
    """(text_id, i, n, r, k): each rotation's first FIRST characters as ``k``, r = 0; a text's pieces are dealt out before they are cut."""
    head = F.substring("seq", 1, FIRST - 1)
    turned = ended.select(F.struct("text_id", F.char_length("seq").cast("bigint").alias("n")).alias("id"), F.concat("seq", F.substring(F.repeat(head, FIRST - 1), 1, FIRST - 1)).alias("seq"))
    pieces = blocks(turned, "id", "seq", FIRST).repartition(partitions(ended.sparkSession))
    each = pieces.select("id", "start", F.posexplode(substrings(F.col("blk"), FIRST)).alias("off", "k"))
    return each.select("id.text_id", (F.col("start") + F.col("off")).alias("i"), "id.n", F.lit(0).cast("bigint").alias("r"), "k")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (text_id, r, k) with what the range itself tells of them.

    ``number``: the row's number in its text; ``start_r`` and ``start_k``: those of the first row with its r, and with its r and k;
    ``alone``: neither neighbour has its r and k. A row waits until the next one is known.
    """
    held, count = None, 0
    starts, news = np.zeros(3, dtype=np.int64), np.ones(3, dtype=bool)  # of text, r and k: where the run began, and whether the next row begins one

    def told(b: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch:
        nonlocal count, starts, news
        rows, n = pa.concat_batches([b, after]) if after is not None else b, b.num_rows
        at = np.arange(count, count + n)
        begins, follows, found = [], [], []
        for j, name in enumerate(("text_id", "r", "k")):
            c = rows.column(name)
            other = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False).astype(bool)
            other = other | follows[-1][: len(other)] if follows else other
            follows.append(other if after is not None else np.append(other, True))
            begins.append(np.append(news[j], follows[j][: n - 1]))
            found.append(np.maximum.accumulate(np.where(begins[j], at, starts[j])))
        starts, news, count = np.array([f[-1] for f in found]), np.array([f[-1] for f in follows]), count + n
        columns = [at - found[0], found[1] - found[0], found[2] - found[0], begins[2] & follows[2]]
        return pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, columns)], [*b.schema.names, "number", "start_r", "start_k", "alone"])

    for b in batches:
        if b.num_rows:
            if held is not None:
                yield told(held, b.slice(0, 1))
            held = b
    if held is not None:
        yield told(held, None)


def _ranked(rows: DataFrame) -> DataFrame:
    """(text_id, i, n, r, tied) of rows (text_id, i, n, r, k): ranks by r and then k, and who still shares one.

    Rows are dealt out by ranges of (text_id, r, k, i), so neither a long text nor a rank that
    many rotations share is one task's work. A run of equal keys may lie in several ranges: a table of a row per range
    and text tells how many rows come before a range and where the run at its beginning began.
    """
    order = ["text_id", "r", "k", "i"]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{c} {t}" for c, t in ranged.dtypes)
    local = materialize(ranged.mapInArrow(_numbered, f"{kinds}, number bigint, start_r bigint, start_k bigint, alone boolean"), "ranges")
    key = F.struct("number", "r", "k")
    ends = local.groupBy("text_id", "part").agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.max("start_r").alias("last_r"), F.max("start_k").alias("last_k"))
    by = Window.partitionBy("text_id").orderBy("part")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"offset": F.coalesce(F.sum("rows").over(before), F.lit(0)), "prev": F.lag("last").over(by), "next": F.lead("first").over(by)})
    same = lambda x, y, c: F.coalesce(F.col(x)[c] == F.col(y)[c], F.lit(False))
    ends = ends.withColumn("on_r", same("prev", "first", "r")).withColumn("on_k", F.col("on_r") & same("prev", "first", "k")).withColumn("goes_on", same("last", "next", "r") & same("last", "next", "k"))
    begun = lambda at, on: F.last(F.when((F.col(at) > 0) | ~F.col(on), F.col("offset") + F.col(at)), ignorenulls=True).over(before)
    facts = ends.select("text_id", "part", "offset", "on_r", "on_k", "goes_on", "last_k", begun("last_r", "on_r").alias("from_r"), begun("last_k", "on_k").alias("from_k"))
    full = local.join(facts, ["text_id", "part"])
    first = lambda at, on, come: F.when((F.col(at) == 0) & F.col(on), F.col(come)).otherwise(F.col("offset") + F.col(at))
    r = F.col("r") + first("start_k", "on_k", "from_k") - first("start_r", "on_r", "from_r")
    tied = ~F.col("alone") | ((F.col("start_k") == 0) & F.col("on_k")) | ((F.col("start_k") == F.col("last_k")) & F.col("goes_on"))
    new = materialize(full.select("text_id", "i", "n", r.alias("r"), tied.alias("tied")), "ranks")
    discard(local)
    return new


def _doubled(ended: DataFrame) -> DataFrame:
    """Ranks by doubling; no window and no task has a whole text.

    A rotation's rank by its first h characters is the number of its text's rotations that begin
    with less. The first ranks are of FIRST characters; each round orders those that share a rank by the
    rank h places on, which makes it one of 2h characters. Rotations alone with their rank are not joined again.
    """
    now, h, done = _ranked(_beginnings(ended)), FIRST, []
    while True:
        open = F.col("tied") & (F.col("n") > h)
        if now.where(open).isEmpty():
            break
        every = reduce(DataFrame.unionByName, [*done, now])
        shifted = every.select("text_id", F.pmod(F.col("i") - h, F.col("n")).alias("i"), F.col("r").alias("k"))
        ordered = _ranked(now.where(open).hint("merge").join(shifted, ["text_id", "i"]).select("text_id", "i", "n", "r", "k"))
        done, now, h = [*done, now.where(~open)], ordered, h * 2
    ranks = reduce(DataFrame.unionByName, [*done, now])
    # what is still tied are the equal rotations of a periodic text: n / rows places apart, in the order of their index
    alike = ranks.where("tied").groupBy("text_id", "r").agg(F.min("i").alias("least"), F.count("*").alias("rows"))
    turn = F.expr("(i - least) * rows div n").cast("bigint")
    periodic = ranks.where("tied").join(alike, ["text_id", "r"]).select("text_id", "i", (F.col("r") + turn).alias("rank"))
    return ranks.where("not tied").select("text_id", "i", F.col("r").alias("rank")).unionByName(periodic)


def bwt_blocks(texts: DataFrame, short: int = SHORT, size: int = 1 << 16) -> DataFrame:
    """(text_id, block, bwt): the last characters of the rotations in rank order, those of ``size`` ranks to a row.

    A row's length is bounded, whatever the text's; the blocks of a text one after another are its ``bwt``.
    """
    brief, long = _brief_and_long(texts, short)
    found = _by_text(brief, _transformed_parts(size), "block bigint, bwt string")
    if long is None:
        return found
    last = characters(long).select("text_id", F.pmod(F.col("i") + 1, F.col("n")).alias("i"), "ch")
    # by a hint, as the files' size tells nothing of how many rows a text becomes
    joined = _doubled(long).hint("merge").join(last, ["text_id", "i"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "ch"))), lambda x: x["ch"])
    return found.unionByName(joined.groupBy("text_id", F.floor(F.col("rank") / size).cast("bigint").alias("block")).agg(F.array_join(ordered, "").alias("bwt")))


def bwt(texts: DataFrame, short: int = SHORT) -> DataFrame:
    """(text_id, bwt): the last character of each rotation, in rank order; a text is one row, so long ones are for ``bwt_blocks``."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "bwt"))), lambda x: x["bwt"])
    return bwt_blocks(texts, short).groupBy("text_id").agg(F.array_join(parts, "").alias("bwt"))


def _counted(rows: pa.RecordBatch, codes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    row, code, n, before = character_counts(codes, starts)
    chars = cut(code, np.arange(len(code)), np.ones(len(code), dtype=np.int64))
    return pa.RecordBatch.from_arrays([rows.column("text_id").take(pa.array(row)), chars, pa.array(n), pa.array(before)], ["text_id", "ch", "n", "c_before"])


def char_table(texts: DataFrame, short: int = SHORT) -> DataFrame:
    """(text_id, ch, n, c_before): how often each character occurs, and how many smaller ones there are.

    The task that has a text of up to ``short`` characters counts them; longer ones, and those whose ids repeat, by groupings.
    """
    single, several = by_repeats(texts.select("id", "seq"), "id")
    brief, long = _brief_and_long(single, short)
    found = _by_text(brief, _counted, "ch string, n bigint, c_before bigint")
    rest = [t for t in (long, None if several is None else closed(several)) if t is not None]
    if not rest:
        return found
    counts = characters(reduce(DataFrame.unionByName, rest)).groupBy("text_id", "ch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("text_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return found.unionByName(counts.withColumn("c_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
