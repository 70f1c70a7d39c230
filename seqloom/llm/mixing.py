"""Mixing sources to target weights.

Documents of a source are put in a hash-random order, distributed prefix sums of
their sizes run along that order, and the order is cut at the source's exact
budget; a budget above the source's size repeats the source whole epochs first.

Defined results
- null text or text without words: size 0, nothing taken;
- null source: a source of its own, after all others;
- null doc_id: placed by the hash of its text instead of its doc_id;
- ties of the hash key fall to doc_id, then size, then the text's hash; repeated rows are rows of their own;
- empty table: empty result; other columns are ignored by ``mix`` and pass through ``apply_mix``, whatever
  their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, partitions, unused

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights go round the sources in code-point order, null last. All targets add
    up to ``share`` of all sizes; a target stops at ``max_epochs`` times its source's
    size and the excess is shared again by weight until none is above. That is a
    water level: target = min(cap, level * weight), and the level follows from
    running sums over the sources in order of cap / weight.
    One row per source enters the two windows below, never one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(pick, (F.col("_rank") % len(weights)).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
        # the level if exactly the sources before this one are capped
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_used")))
        .withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
        # the first free source fixes the level; if none is free all are capped
        .withColumn("_water", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap")))
    return level.select("source", "source_size", target.alias("target"))


def _local_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes before each row inside its partition and source (rows come sorted by source)."""
    source, total, first = None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        names, size = b.column("source").to_pylist(), b.column("size").to_numpy()
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        before = np.empty(len(names), dtype=np.int64)
        for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if first or names[lo] != source:
                source, total, first = names[lo], 0, False
            run = np.cumsum(size[lo:hi])
            before[lo:hi] = total + run - size[lo:hi]
            total += int(run[-1])
        yield b.append_column("before", pa.array(before))


def _order_columns(docs: DataFrame, size: Column, seed: int) -> dict[str, Column]:
    """What places a row in its source's order, by name: key, doc_id, size and the text's hash."""
    tie = F.xxhash64(F.lit(seed), "text") if "text" in docs.columns else F.lit(0).cast("bigint")
    doc_id = F.col("doc_id").cast("bigint")
    return {"key": F.when(doc_id.isNull(), tie).otherwise(F.xxhash64(F.lit(seed), doc_id)), "doc_id": doc_id, "size": size, "tie": tie}


def _placed(docs: DataFrame, size: Column, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """Per row of ``docs``: (source, key, doc_id, size, tie, before, source_size, target, epochs, rest).

    ``before`` counts the source's words that come before the row; the mix takes ``epochs`` whole
    passes of a source and the first ``rest`` words of another.
    """
    spark = docs.sparkSession
    light = materialize(docs.select(F.col("source").cast("string").alias("source"), *[c.alias(n) for n, c in _order_columns(docs, size, seed).items()]), "mix-rows")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")]
    ranged = light.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = materialize(ranged.mapInArrow(_local_prefix, "source string, key bigint, doc_id bigint, size bigint, tie bigint, part int, before bigint"), "mix-order")
    discard(light)
    per_part = local.groupBy("source", "part").agg(F.sum("size").alias("n"))
    shift = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("source", "part", F.coalesce(F.sum("n").over(shift), F.lit(0)).alias("shift"))
    targets = source_targets(per_part.select("source", F.col("n").alias("size")), weights, share, max_epochs)
    # a row per source and range partition: small beside the documents, and checked by Spark before it broadcasts
    facts = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "o.part", "o.shift", "t.source_size", "t.target")
    full = local.alias("d").join(facts.alias("f"), F.expr("d.source <=> f.source and d.part = f.part"))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    return full.select("d.source", "key", "doc_id", "size", "tie", (F.col("before") + F.col("shift")).alias("before"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))


def _within(size: Column, words: Column) -> Column:
    """What of ``words`` a row of ``size`` words takes."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(size, words))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: (doc_id, source, size, source_size, target, taken).

    ``taken`` counts the words that the mix takes from the document, repeats
    included: epochs whole passes, plus what of the last pass lies before the
    source's budget (the document on the cut is taken in part).

    Only (source, key, doc_id, size, tie) is shuffled, range-sorted by (source, key), so a
    source with a third of all rows spreads over a third of the partitions. The
    totals by (source, partition) that turn local sums into global ones are one row
    per source and partition.
    """
    placed = _placed(docs, word_count(F.col("text")) if size is None else size, weights, share, max_epochs, seed)
    taken = F.col("epochs") * F.col("size") + _within(F.col("size"), F.col("rest") - F.col("before"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word, white space as it was."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(n.cast("int"), F.lit(0))), "")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row per whole repeat, and the cut one shortened.

    A row per source says how many epochs it has, which place in the order the cut has and how many
    words are left there, so that each document is decided where it is and no text is shuffled. Rows
    that share the place of a cut in all of key, doc_id, size and text are numbered and take the
    rest in turn. Documents without words are in no budget and go.
    """
    size = word_count(F.col("text"))
    columns = _order_columns(docs, size, seed)
    placed = materialize(_placed(docs, size, weights, share, max_epochs, seed), "mix-placed")
    place = F.struct(*columns)
    cut = placed.where("size > 0 and before < rest and before + size >= rest").select(F.col("source").alias("s"), place.alias("at"))
    alike = placed.join(cut, placed["source"].eqNullSafe(cut["s"])).where(place == F.col("at"))
    alike = alike.groupBy("s", "at").agg(F.count("*").alias("rows"), F.min("before").alias("start"))
    sources = placed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max("rest").alias("rest"))
    mixed, src, own, words, copy = (unused(docs, n) for n in ("mixed", "mixed_source", "mixed_place", "mixed_words", "mixed_copy"))
    facts = sources.join(alike, sources["source"].eqNullSafe(alike["s"]), "left")
    facts = materialize(facts.select(F.col("source").alias(src), F.struct("epochs", "at", F.coalesce("rows", F.lit(0)).alias("rows"), (F.col("rest") - F.col("start")).alias("left")).alias(mixed)), "mix-cuts")
    # a row per source, which Spark broadcasts if its files are small
    held = docs.join(facts, F.col("source").cast("string").eqNullSafe(F.col(src))).withColumn(own, F.struct(*[c.alias(n) for n, c in columns.items()]))
    fact, n = F.col(mixed), F.col(own)["size"]
    on_cut = F.coalesce(F.col(own) == fact["at"], F.lit(False))
    before_cut = F.coalesce(F.col(own) < fact["at"], F.lit(False))
    part = F.when(before_cut, n).when(on_cut, _within(n, fact["left"])).otherwise(F.lit(0))
    shared = on_cut & (fact["rows"] > 1)
    taken = held.where(~shared).withColumn(words, fact["epochs"] * n + part)
    if not facts.where(F.col(mixed)["rows"] > 1).isEmpty():
        taken = taken.unionByName(_in_turn(held.where(shared), src, mixed, own, words))
    copies = F.ceil(F.col(words) / n).cast("int")
    full = taken.where(F.col(words) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    left = F.col(words) - (F.col(copy) - 1) * n
    text = F.when(left < n, first_words(F.col("text"), left)).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.char_length(text)}
    return full.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(c) for c in docs.columns])


def _in_turn(tied: DataFrame, src: str, mixed: str, own: str, words: str) -> DataFrame:
    """Rows on their source's cut with the words that each takes, in the order of a number that is written with them."""
    number, part, turn, ahead = (unused(tied, n) for n in ("number", "part", "turn", "ahead"))
    rows = materialize(tied.withColumn(number, F.monotonically_increasing_id()), "mix-ties")
    rows = rows.withColumn(part, F.shiftright(number, 33))  # the number's task
    rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(src, part).orderBy(number)) - 1)
    counts = rows.groupBy(F.col(src).alias("s"), F.col(part).alias("p")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "p", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(ahead))
    full = rows.join(counts, F.col(src).eqNullSafe(F.col("s")) & (F.col(part) == F.col("p")))
    n, fact = F.col(own)["size"], F.col(mixed)
    return full.withColumn(words, fact["epochs"] * n + _within(n, fact["left"] - (F.col(ahead) + F.col(turn)) * n)).drop(number, part, turn, ahead, "s", "p")
