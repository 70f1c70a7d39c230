"""Alignment as scored joins of pairs: filter by bounds, score, and make strings for the survivors only.

Pairs are rows (pair_id, seq1, seq2). Null in, null out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .patterns import pattern_locate
from .seeds import seed_extend, seed_join, top_hits

DELETIONS = {0: 1 << 30, 1: 256, 2: 40}  # edits, and the characters up to which texts are compared by deletions
TILE = 4096  # characters of a long text between the beginnings of two tiles


def candidate_pairs(queries: DataFrame, refs: DataFrame, k: int = 11) -> DataFrame:
    """(query_id, ref_id, seq1, seq2) of pairs that share a k-mer."""
    ids = seed_join(queries, refs, k).select("query_id", "ref_id").distinct()
    return ids.join(queries.select(F.col("id").alias("query_id"), F.col("seq").alias("seq1")), "query_id").join(refs.select(F.col("id").alias("ref_id"), F.col("seq").alias("seq2")), "ref_id").select("query_id", "ref_id", "seq1", "seq2")


def by_edit_distance(match: int, mismatch: int, gap: int) -> bool:
    """Whether the global score follows from the edit distance: mismatch = gap + match / 2."""
    return match % 2 == 0 and mismatch == gap + match // 2 and match > mismatch


def _kernel(pairs: DataFrame, kind: str, scores: tuple[int, ...], strings: bool) -> DataFrame:
    """(pair_id, score[, aligned1, aligned2]) by the numpy kernels, a batch of pairs at a time."""
    id_type = pairs.schema["pair_id"].dataType.simpleString()
    run = {"global": kernels.global_scores, "local": kernels.local_scores, "affine": kernels.affine_scores}[kind]
    trace = {"global": kernels.global_strings, "local": kernels.local_strings, "affine": kernels.affine_strings}[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = b.column("seq1").to_pylist(), b.column("seq2").to_pylist()
            if strings:
                got = [trace(x, y, *scores) for x, y in zip(one, two, strict=True)]
                told = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("pair_id"), *told], ["pair_id", "aligned1", "aligned2", "score"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("pair_id"), pa.array(run(one, two, *scores), pa.int64())], ["pair_id", "score"])

    columns = "aligned1 string, aligned2 string, score bigint" if strings else "score bigint"
    known = pairs.select("pair_id", F.col("seq1").cast("string").alias("seq1"), F.col("seq2").cast("string").alias("seq2"))
    # pairs of like lengths in one batch waste no cells
    dealt = known.where("seq1 is not null and seq2 is not null").repartition(pairs.sparkSession.sparkContext.defaultParallelism * 2).sortWithinPartitions(F.char_length("seq1") + F.char_length("seq2"))
    scored = dealt.mapInArrow(work, f"pair_id {id_type}, {columns}")
    return scored


def _with_nulls(scored: DataFrame, pairs: DataFrame, min_score: int | None) -> DataFrame:
    """Null pairs with null results, unless a least score is asked for."""
    if min_score is not None:
        return scored.where(F.col("score") >= min_score)
    rest = pairs.where("seq1 is null or seq2 is null").select("pair_id", *[F.lit(None).cast(t).alias(c) for c, t in scored.dtypes if c != "pair_id"])
    return scored.unionByName(rest)


def _check(match: int, mismatch: int, *gaps: int) -> None:
    if any(g > 0 for g in gaps):
        raise ValueError("gap scores must be 0 or less")


def global_bound(match: int, mismatch: int, gap: int) -> Column:
    """What a pair's global score cannot exceed (for match > 0, mismatch <= match, gap <= 0)."""
    m, n = F.char_length("seq1"), F.char_length("seq2")
    return match * F.least(m, n) + gap * F.abs(m - n)


def shared_characters() -> Column:
    """How many characters seq1 and seq2 have in common, each counted as often as in the text that has fewer of it; null beside a null."""
    short, long = (F.when((F.char_length("seq1") <= F.char_length("seq2")) == first, F.col("seq1")).otherwise(F.col("seq2")) for first in (True, False))
    count = lambda t, c: F.char_length(t) - F.char_length(F.replace(t, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(short, "")), F.lit(0), lambda n, c: n + F.least(count(short, c), count(long, c)))
    return F.when(F.col("seq1").isNotNull() & F.col("seq2").isNotNull(), common)


def local_bound(match: int, mismatch: int) -> Column:
    """What a pair's local score cannot exceed: equal characters are shared ones, and no more columns than the shorter text has characters lack gaps."""
    one, two = F.char_length("seq1"), F.char_length("seq2")
    least = F.when(one <= two, one).when(one > two, two)
    if match <= mismatch:
        return max(mismatch, 0) * least
    shared = shared_characters()
    return max(match, 0) * shared + max(mismatch, 0) * (least - shared)


def global_score_join(pairs: DataFrame, match: int = 1, mismatch: int = -1, gap: int = -1, min_score: int | None = None) -> DataFrame:
    """(pair_id, score): the best end-to-end score.

    Where mismatch = gap + match / 2 the score is match * (m + n) / 2 less (match - mismatch)
    times the edit distance, a built-in function; otherwise a kernel fills the cells. A least
    score first drops pairs whose lengths cannot reach it, and before the kernel those whose characters
    cannot: what the longer text has beyond the shared characters takes an edit each.
    """
    _check(match, mismatch, gap)
    if min_score is not None and match > 0 and mismatch <= match:
        pairs = pairs.where(global_bound(match, mismatch, gap) >= min_score)
    if by_edit_distance(match, mismatch, gap):
        value = match // 2 * (F.char_length("seq1") + F.char_length("seq2")) - (match - mismatch) * F.levenshtein("seq1", "seq2")
        scored = pairs.select("pair_id", value.cast("bigint").alias("score"))
        return scored if min_score is None else scored.where(F.col("score") >= min_score)
    if min_score is not None and match > 0 and mismatch < match:
        m, n = F.char_length("seq1"), F.char_length("seq2")
        pairs = pairs.where(most_edits(match, mismatch, gap, min_score, m, n) >= F.greatest(m, n) - shared_characters())
    return _with_nulls(_kernel(pairs, "global", (match, mismatch, gap), False), pairs, min_score)


def most_edits(match: int, mismatch: int, gap: int, min_score: int, m: Column, n: Column) -> Column:
    """How many mismatches and gap characters an alignment of m and n characters with ``min_score`` can have; below 0: there is none.

    Each of the m + n characters is worth match / 2; a mismatch loses match - mismatch of that, a gap's character match / 2 - gap.
    """
    loss = min(2 * (match - mismatch), match - 2 * gap)
    return F.floor((match * (m + n) - 2 * min_score) / F.lit(loss)).cast("int")


def _rests(text: Column, d: Column) -> Column:
    """array<bigint>: hashes of what is left of a text after at most ``d`` deletions, for the d of DELETIONS."""
    less = lambda t: F.when(F.char_length(t) > 0, F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda p: F.concat(F.substr(t, F.lit(1), p - 1), F.substr(t, p + 1, F.char_length(t))))).otherwise(F.array().cast("array<string>"))
    none, one = F.array(text), F.array_distinct(less(text))
    two = F.array_distinct(F.flatten(F.transform(one, less)))
    rests = F.when(d == 0, none).when(d == 1, F.concat(none, one)).otherwise(F.concat(none, one, two))
    return F.array_distinct(F.transform(rests, lambda t: F.xxhash64(t)))


def global_score_pairs(left: DataFrame, right: DataFrame, min_score: int, match: int = 1, mismatch: int = -1, gap: int = -1) -> DataFrame:
    """(id1, id2, score): all pairs of two tables (id, seq) whose global score is ``min_score`` or more.

    Candidates meet without loss in an equi-join, for each length that a partner can have. Where d edits are few for
    the length (DELETIONS), both sides give what is left of a text after at most d deletions: texts within d
    edits have one such rest in common, and texts that have are within 2 d, so common beginnings cost nothing.
    Elsewhere by the pigeonhole principle: one of the d + 1 even segments of the first lies unchanged in the second, at most d
    places from its own; a segment that many texts share makes many candidates there. Where ``min_score`` allows
    as many edits as there are characters, a segment is empty and all texts of those lengths are candidates,
    as nearly all are results. Different texts are compared, and their ids join the results, so copies cost only the
    rows that they are in. Ids must not repeat; null ids and texts have no pairs.
    """
    _check(match, mismatch, gap)
    if match <= 0 or mismatch >= match:
        raise ValueError("match must be above 0 and above mismatch")
    members = [t.select("id", "seq").where("id is not null and seq is not null") for t in (left, right)]
    sides = [m.select("seq").distinct().withColumn("len", F.char_length("seq")) for m in members]
    # lengths that occur: at most as many as the longest text has characters
    lengths = [[r["len"] for r in t.select("len").distinct().orderBy("len").collect()] for t in sides]
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs)) or "-1"), ",").cast("array<int>")
    able = lambda m, n: most_edits(match, mismatch, gap, min_score, m, n) >= F.abs(m - n)
    cut = lambda m, d, i: F.floor(m.cast("bigint") * i / (d + 1)).cast("int")
    own, other = F.col("len"), F.col("other")
    partners = lambda t, xs: t.select("seq", "len", F.explode(F.filter(numbers(xs), lambda x: able(F.col("len"), x))).alias("other")).withColumn("d", most_edits(match, mismatch, gap, min_score, own, other))
    short = F.lit(False)
    for d, most in DELETIONS.items():
        short = short | ((F.col("d") == d) & (F.greatest("len", "other") <= most))
    tried = [partners(sides[0], lengths[1]), partners(sides[1], lengths[0])]
    few = [t.where(short).withColumn("key", F.explode(_rests(F.col("seq"), F.col("d")))) for t in tried]
    # joins by hint: the files' size tells nothing of how many rows a text becomes, and a broadcast would pass them through the driver
    near = few[0].select(F.col("seq").alias("seq1"), F.col("len").alias("m"), F.col("other").alias("n"), "key").hint("merge").join(few[1].select(F.col("seq").alias("seq2"), F.col("other").alias("m"), F.col("len").alias("n"), "key"), ["m", "n", "key"])
    one, two = (t.where(~short).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))) for t in tried)
    begin, end = cut(own, F.col("d"), F.col("i")), cut(own, F.col("d"), F.col("i") + 1)
    one = one.select(F.col("seq").alias("seq1"), F.col("len").alias("m"), F.col("other").alias("n"), "i", F.substr("seq", begin + 1, end - begin).alias("segment"))
    begin, end = cut(other, F.col("d"), F.col("i")), cut(other, F.col("d"), F.col("i") + 1)
    first, last = F.greatest(F.lit(0), begin - F.col("d")), F.least(own - (end - begin), begin + F.col("d"))
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    found = F.array_distinct(F.transform(places, lambda p: F.substr(F.col("seq"), p + 1, end - begin)))
    two = two.select(F.col("seq").alias("seq2"), F.col("other").alias("m"), F.col("len").alias("n"), "i", F.explode(found).alias("segment"))
    texts = one.hint("merge").join(two, ["m", "n", "i", "segment"]).select("seq1", "seq2").unionByName(near.select("seq1", "seq2")).distinct()
    scored = global_score_join(texts.select(F.struct("seq1", "seq2").alias("pair_id"), "seq1", "seq2"), match, mismatch, gap, min_score)
    found = scored.select("pair_id.seq1", "pair_id.seq2", "score")
    first, second = (m.select(F.col("id").alias(f"id{n}"), F.col("seq").alias(f"seq{n}")) for n, m in enumerate(members, 1))
    return found.hint("merge").join(first, "seq1").hint("merge").join(second, "seq2").select("id1", "id2", "score")


def _survivors(pairs: DataFrame, scored: DataFrame, top: int | None) -> DataFrame:
    """The pairs that were scored and are among the best ``top``."""
    if top is not None:
        scored = scored.orderBy(F.desc("score"), "pair_id").limit(top)
    return pairs.join(scored.select("pair_id"), "pair_id", "left_semi")


def _alignments(pairs: DataFrame, scored: DataFrame | None, kind: str, scores: tuple[int, ...], min_score: int | None, top: int | None) -> DataFrame:
    held = pairs if min_score is None and top is None else _survivors(pairs, scored, top)
    return _with_nulls(_kernel(held, kind, scores, True), held, min_score)


def global_alignments(pairs: DataFrame, match: int = 1, mismatch: int = -1, gap: int = -1, min_score: int | None = None, top: int | None = None) -> DataFrame:
    """(pair_id, aligned1, aligned2, score); among equal paths a diagonal step, then a gap in seq2, then one in seq1.

    With ``min_score`` or ``top``, scores decide first which pairs survive, and only those are traced. Long pairs keep every
    few rows and fill the rows between again on the way back, for the same strings.
    """
    scored = None if min_score is None and top is None else global_score_join(pairs, match, mismatch, gap, min_score)
    return _alignments(pairs, scored, "global", (match, mismatch, gap), min_score, top)


def _tiled_scores(pairs: DataFrame, kind: str, scores: tuple[int, ...], gap: int, min_score: int | None) -> DataFrame:
    """(pair_id, score) of local alignment; a long text is scored in tiles, each in a task of its own.

    A positive local alignment has at most m characters of the shorter text, and as each gap's character costs
    ``gap``, at most m + m * match / -gap of the longer one. Tiles that overlap by so much hold every
    alignment whole, so the best of a pair's tiles is its score. With ``min_score`` tiles whose characters cannot
    reach it are left out, and pairs that cannot have no row.
    """
    match = max(scores[:2])
    if min_score is not None:
        pairs = pairs.where(max(match, 0) * F.least(F.char_length("seq1"), F.char_length("seq2")) >= min_score)
    one, two = F.char_length("seq1"), F.char_length("seq2")
    least, most = F.least(one, two), F.greatest(one, two)
    span = least + F.floor(least * match / F.lit(max(1, -gap))).cast("int")
    step = F.greatest(F.lit(TILE), span)
    cut = F.regexp_extract_all("long", F.format_string("(?s)(?=(.{1,%d})).{1,%d}", F.col("step") + F.col("span") - 1, F.col("step")), F.lit(1))
    whole = (F.col("most") < 2 * F.col("step")) if match > 0 and gap < 0 else F.lit(True)
    told = pairs.where("seq1 is not null and seq2 is not null").select(
        F.struct(F.monotonically_increasing_id().alias("row"), "pair_id").alias("pair_id"), F.when(one <= two, F.col("seq1")).otherwise(F.col("seq2")).alias("short"),
        F.when(one <= two, F.col("seq2")).otherwise(F.col("seq1")).alias("long"), span.alias("span"), step.alias("step"), most.alias("most"),
    )
    tiles = told.select("pair_id", F.col("short").alias("seq1"), F.explode(F.when(whole, F.array("long")).otherwise(cut)).alias("seq2"))
    if min_score is not None:
        tiles = tiles.where(local_bound(*scores[:2]) >= min_score)
    return _kernel(tiles, kind, scores, False).groupBy("pair_id").agg(F.max("score").alias("score")).select("pair_id.pair_id", "score")


def local_score_join(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap: int = -1, min_score: int | None = None) -> DataFrame:
    """(pair_id, score): the best score of two substrings, 0 or more; long texts in tiles."""
    _check(match, mismatch, gap)
    return _with_nulls(_tiled_scores(pairs, "local", (match, mismatch, gap), gap, min_score), pairs, min_score)


def local_alignments(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap: int = -1, min_score: int | None = None, top: int | None = None) -> DataFrame:
    """(pair_id, aligned1, aligned2, score) of the first best cell in row order; ties as in ``global_alignments``."""
    scored = None if min_score is None and top is None else local_score_join(pairs, match, mismatch, gap, min_score)
    return _alignments(pairs, scored, "local", (match, mismatch, gap), min_score, top)


def local_affine_join(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -1, min_score: int | None = None) -> DataFrame:
    """(pair_id, score): as ``local_score_join``; a gap of length L costs gap_open + L * gap_extend."""
    _check(match, mismatch, gap_open, gap_extend)
    return _with_nulls(_tiled_scores(pairs, "affine", (match, mismatch, gap_open, gap_extend), gap_extend, min_score), pairs, min_score)


def local_affine_alignments(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap_open: int = -3, gap_extend: int = -1, min_score: int | None = None, top: int | None = None) -> DataFrame:
    """(pair_id, aligned1, aligned2, score) of the last best cell; the strings re-score to the score."""
    scored = None if min_score is None and top is None else local_affine_join(pairs, match, mismatch, gap_open, gap_extend, min_score)
    return _alignments(pairs, scored, "affine", (match, mismatch, gap_open, gap_extend), min_score, top)


def match_line(aligned1: Column, aligned2: Column) -> Column:
    """``|`` where the aligned strings agree, a blank elsewhere."""
    n = F.char_length(aligned1)
    chars = lambda c: F.slice(F.split(c, ""), F.lit(1), n)
    return F.array_join(F.zip_with(chars(aligned1), chars(aligned2), lambda x, y: F.when(x == y, F.lit("|")).otherwise(F.lit(" "))), "")


def identity(aligned1: Column, aligned2: Column) -> Column:
    """Share of agreeing places; null for empty strings."""
    line = match_line(aligned1, aligned2)
    return F.char_length(F.replace(line, F.lit(" "), F.lit(""))) / F.nullif(F.char_length(line), F.lit(0))


def compare_methods(queries: DataFrame, refs: DataFrame, k: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, ref_id, global_score, local_score, seed_score, seed_ref_start, seed_ref_end, count, positions) per pair.

    ``pairs`` (query_id, ref_id) says which; by default those that share a k-mer. Methods that
    find nothing give null, or 0 and [] for the exact search.
    """
    if pairs is None:
        held = candidate_pairs(queries, refs, k)
    else:
        held = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("seq").alias("seq1")), "query_id").join(refs.select(F.col("id").alias("ref_id"), F.col("seq").alias("seq2")), "ref_id")
    keyed = held.withColumn("pair_id", F.to_json(F.struct("query_id", "ref_id")))  # one string per pair, whatever the ids hold
    g = global_score_join(keyed).withColumnRenamed("score", "global_score")
    s = local_score_join(keyed).withColumnRenamed("score", "local_score")
    best = Window.partitionBy("query_id", "ref_id").orderBy(F.desc("score"), "query_pos", "ref_pos")
    hits = seed_extend(queries, refs, k, dedup=True).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    hits = hits.select("query_id", "ref_id", F.col("score").alias("seed_score"), F.col("ref_start").alias("seed_ref_start"), F.col("ref_end").alias("seed_ref_end"))
    known = queries.select(F.col("id").alias("query_id"), F.col("seq").alias("pattern"))
    exact = pattern_locate(refs, known.select("pattern")).join(known, "pattern").groupBy("query_id", F.col("text_id").alias("ref_id")).agg(F.count("*").alias("count"), F.sort_array(F.collect_list("pos")).alias("positions"))
    full = keyed.select("query_id", "ref_id", "pair_id").join(g, "pair_id", "left").join(s, "pair_id", "left").join(hits, ["query_id", "ref_id"], "left").join(exact, ["query_id", "ref_id"], "left")
    return full.select("query_id", "ref_id", "global_score", "local_score", "seed_score", "seed_ref_start", "seed_ref_end", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("positions", F.array().cast("array<bigint>")).alias("positions"))


__all__ = ["by_edit_distance", "candidate_pairs", "compare_methods", "global_alignments", "global_bound", "global_score_join", "global_score_pairs", "identity", "local_affine_alignments", "local_affine_join", "local_alignments", "local_bound", "local_score_join", "match_line", "most_edits", "shared_characters", "top_hits"]
