"""Exact search of patterns over a table of texts, overlapping occurrences included.

Places are found by anchors. A pattern of at least ``anchor`` characters has the minimizer of its
first window: of the window's k-mers, the leftmost of the least hash. A text keeps the minimizers of
all its windows, about 2 in w + 1 of its k-mers; wherever the pattern occurs, the text has that
window and so the same minimizer. Where patterns are few, the first characters
do. A shorter pattern is its own anchor and meets all substrings of its length. An anchor met is a
candidate, and the pattern is compared at that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .kmers import BLOCK, blocks, hashed, met_places, spread_out, substrings

ANCHOR = 12
BROADCAST_CHARS = 2_000_000  # of patterns up to which they are broadcast
LONG = 512  # characters of a pattern that are compared with what is fetched at its place
# An anchor is a number: a hash, five bits for its class (a short pattern's length, else 0), eight for its place in the block.
PLACE, CLASS = 255, 31 << 8


def _usable(patterns: DataFrame) -> DataFrame:
    """Distinct patterns that are neither null nor empty."""
    return patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct()


def _anchors_at(text: Column, n: Column, width: int, kind: int) -> Column:
    """array<bigint>: the anchors of class ``kind`` at the first ``n`` places of a text, ``width`` characters each."""
    number = lambda x, i: F.xxhash64(x).bitwiseAND(~(PLACE | CLASS)).bitwiseOR(F.lit(kind << 8)).bitwiseOR(i)
    return F.transform(substrings(F.substring(text, F.lit(1), n + (width - 1)), width), number)


def _minimizers(text: Column, windows: int, k: int, w: int) -> Column:
    """array<bigint>: the distinct minimizers of the windows of ``w`` k-mers that begin at the first places of a text."""
    all = _anchors_at(text, F.lit(windows + w - 1), k, 0)
    least = lambda h: F.array_distinct(F.filter(F.transform(h, lambda x, j: F.when(j + w <= F.size(h), F.least(x, *[F.get(h, j + i) for i in range(1, w)]))), lambda x: x.isNotNull()))
    # bound to a variable, so that the hashes are taken once and not for each window
    return all if w == 1 else F.transform(F.array(all), least)[0]


def pattern_locate(texts: DataFrame, patterns: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(text_id, pattern, pos) per occurrence in texts (id, seq), positions from 0.

    Texts are cut into blocks once, and all classes of anchors come from the same pass. Up to
    BROADCAST_CHARS characters of patterns are broadcast, and hashes of their anchors leave the
    other places of a block out before rows are made. Beyond that the
    anchors of both sides meet by a shuffle of (id, place, anchor), and the candidates fetch their blocks.
    Of a pattern of more than LONG characters the rest is compared in the text itself.
    """
    if not 1 <= anchor <= 31:
        raise ValueError("anchor must be from 1 to 31")
    kind = F.when(F.char_length("pattern") < anchor, F.char_length("pattern")).otherwise(F.lit(0))
    known = _usable(patterns).withColumn("kind", kind)
    sizes = {r["kind"]: r for r in known.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.char_length("pattern")).alias("chars"), F.max(F.char_length("pattern")).alias("most")).collect()}  # a row per class
    if not sizes:
        return texts.where("false").select(F.col("id").alias("text_id"), F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("pos"))
    most = max(r["most"] for r in sizes.values())
    small = sum(r["chars"] for r in sizes.values()) <= BROADCAST_CHARS
    begun = F.substring(F.col("pattern"), 1, LONG) if most > LONG else F.col("pattern")
    if small:
        anchors = known.select("pattern", F.when(F.col("kind") == 0, anchor).otherwise(F.col("kind")).alias("n")).withColumn("key", hashed(F.substr("pattern", F.lit(1), F.col("n"))))
        met = met_places(texts, anchors, {a or anchor: a or max(min(most, LONG), anchor) for a in sizes}).join(F.broadcast(anchors), ["n", "key"])
        found = met.where(F.substring("piece", 1, F.char_length(begun)) == begun).select(F.col("id").alias("text_id"), "pattern", "pos")
    else:
        met = _shuffled(texts, known, sizes, most, anchor)
        found = met.where(F.substring(F.col("blk"), F.col("at") + 1, F.char_length(begun)) == begun).select(F.col("id").alias("text_id"), "pattern", (F.col("start") + F.col("at")).alias("pos"))
    if most <= LONG:
        return found
    rest = found.where(F.char_length("pattern") > LONG).join(texts.select(F.col("id").alias("text_id"), "seq"), "text_id")
    same = F.substring(F.col("seq"), (F.col("pos") + 1).cast("int"), F.char_length("pattern")) == F.col("pattern")
    return found.where(F.char_length("pattern") <= LONG).unionByName(rest.where(same).select("text_id", "pattern", "pos"))


def _shuffled(texts: DataFrame, known: DataFrame, sizes: dict, most: int, anchor: int) -> DataFrame:
    """(id, start, blk, at, pattern) of the candidates of many patterns: the anchors of both sides meet by a shuffle."""
    k = max(1, anchor * 2 // 3)
    w = anchor - k + 1
    key = lambda x: F.col(x).bitwiseAND(~PLACE)
    own = F.lit(None).cast("bigint")
    for a in sorted(sizes):
        own = F.when(F.col("kind") == a, F.get(_anchors_at(F.col("pattern"), F.lit(1), a, a) if a else _minimizers(F.col("pattern"), 1, k, w), F.lit(0))).otherwise(own)
    anchors = known.select("pattern", own.alias("_p")).select("pattern", key("_p").alias("key"), F.col("_p").bitwiseAND(PLACE).cast("int").alias("ahead"))
    cut = blocks(spread_out(texts.select("id", "seq")), "id", "seq", min(a or anchor for a in sizes), BLOCK, max(min(most, LONG), anchor))
    blk = F.col("blk")
    places = [_anchors_at(blk, F.lit(BLOCK), a, a) if a else _minimizers(blk, BLOCK, k, w) for a in sorted(sizes)]
    met = cut.select("id", "start", F.explode(F.concat(*places) if len(places) > 1 else places[0]).alias("_p"))
    met = met.withColumn("key", key("_p")).join(anchors, "key")
    # a window belongs to the block in which it begins
    met = met.withColumn("at", F.col("_p").bitwiseAND(PLACE).cast("int") - F.col("ahead")).where(F.col("at").between(0, BLOCK - 1))
    return met.join(cut, ["id", "start"])


def pattern_count(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, count) of patterns that occur; overlaps count."""
    return pattern_locate(texts, patterns).groupBy("text_id", "pattern").agg(F.count("*").alias("count"))


def pattern_positions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, count, positions) of patterns that occur; positions ascending."""
    return pattern_locate(texts, patterns).groupBy("text_id", "pattern").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("pos")).alias("positions"))


def pattern_search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, count, positions) for every text and pattern; absent ones have 0 and [].

    The result itself is texts x patterns; ``pattern_positions`` has the occurring ones only.
    """
    ids = texts.select(F.col("id").alias("text_id"))
    held = materialize(pattern_positions(texts, patterns), "positions")
    there = held.groupBy("text_id").agg(F.collect_set("pattern").alias("_there"))
    # the absent ones are told beside each text, so that texts x patterns is never shuffled
    rest = ids.join(there, "text_id", "left").crossJoin(F.broadcast(_usable(patterns))).where(~F.coalesce(F.array_contains("_there", F.col("pattern")), F.lit(False)))
    return ids.join(held, "text_id").select("text_id", "pattern", "count", "positions").unionByName(rest.select("text_id", "pattern", F.lit(0).cast("bigint").alias("count"), F.array().cast("array<bigint>").alias("positions")))


def search_with_prefix_fallback(texts: DataFrame, patterns: DataFrame, prefix: int = 6) -> DataFrame:
    """(text_id, pattern, searched, used_prefix, count, positions): texts without the pattern are searched for its prefix.

    Only pairs with a hit of either kind are returned.
    """
    full = pattern_positions(texts, patterns)
    known = _usable(patterns).select("pattern", F.substring("pattern", 1, prefix).alias("searched"))
    short = pattern_positions(texts, known.select(F.col("searched").alias("pattern"))).withColumnRenamed("pattern", "searched")
    tried = short.join(known, "searched").join(full.select("text_id", "pattern"), ["text_id", "pattern"], "left_anti")
    columns = ["text_id", "pattern", "searched", "used_prefix", "count", "positions"]
    return full.withColumn("searched", F.col("pattern")).withColumn("used_prefix", F.lit(False)).select(*columns).unionByName(tried.withColumn("used_prefix", F.lit(True)).select(*columns))


def match_context(matches: DataFrame, texts: DataFrame, flank: int = 3, first: bool = False) -> DataFrame:
    """(text_id, pattern, pos, before, match, after) of matches (text_id, pattern, pos); ``first``: the first of each pair."""
    if first:
        matches = matches.groupBy("text_id", "pattern").agg(F.min("pos").alias("pos"))
    full = matches.join(texts.select(F.col("id").alias("text_id"), "seq"), "text_id")
    n, p = F.char_length("pattern"), F.col("pos").cast("int")
    start = F.greatest(F.lit(0), p - flank)
    return full.select("text_id", "pattern", "pos", F.substring(F.col("seq"), start + 1, p - start).alias("before"), F.substring(F.col("seq"), p + 1, n).alias("match"), F.substring(F.col("seq"), p + n + 1, F.lit(flank)).alias("after"))


def matched(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Texts in which some pattern occurs."""
    return texts.join(pattern_locate(texts, patterns).select(F.col("text_id").alias("id")), "id", "left_semi")


def unmatched(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Texts in which no pattern occurs."""
    return texts.join(pattern_locate(texts, patterns).select(F.col("text_id").alias("id")), "id", "left_anti")


def matched_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct patterns that occur in some text."""
    return _usable(patterns).join(pattern_locate(texts, patterns), "pattern", "left_semi")


def unmatched_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct patterns that occur in no text."""
    return _usable(patterns).join(pattern_locate(texts, patterns), "pattern", "left_anti")
