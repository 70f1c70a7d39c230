"""Queries over the driver's tables, one or more per operator, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, kmers, patterns, seeds, suffix
from ..sources.tables import materialize, scratch_path, table

K_SEED = 20


def _as(df: DataFrame, id: str, seq: str) -> DataFrame:
    return df.select(F.col(id).cast("bigint").alias("id"), F.col(seq).alias("seq"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _as(table(spark, sf, "part"), "p_partkey", "p_name")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _as(table(spark, sf, "documents"), "doc_id", "text")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _as(table(spark, sf, "benchmark"), "item_id", "text")


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve and twenty characters from the middle of each whole passage, and six with an ending that occurs nowhere.

    Passages of under 50 characters give two patterns, of under 30 one.
    """
    text = F.col("seq")
    cuts = F.array(F.substring(text, 30, 12), F.substring(text, 50, 20), F.concat(F.substring(text, 30, 6), F.lit("#absent")))
    return _items(spark, sf).select(F.explode(cuts).alias("pattern"))


def _name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name with that of the next part key."""
    one = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("pair_id"), F.col("p_name").alias("seq1"))
    two = table(spark, sf, "part").select((F.col("p_partkey").cast("bigint") - 1).alias("pair_id"), F.col("p_name").alias("seq2"))
    return one.join(two, "pair_id")


def _joined(positions: str = "positions"):
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",").alias("positions")


def k1_kmers(spark, sf):
    return kmers.kmers(_parts(spark, sf), k=4)


def k1_kmers_long(spark, sf):
    """How often the texts' k-mers occur, over whole documents."""
    return kmers.kmers(_documents(spark, sf), k=6).groupBy("kmer").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def k2_postings(spark, sf):
    return kmers.kmer_postings(kmers.kmers(_parts(spark, sf), k=5)).select("kmer", "n", _joined())


def k2_postings_by_id(spark, sf):
    return kmers.kmer_postings(kmers.kmers(_parts(spark, sf), k=2), by_id=True).select("id", "kmer", "n", _joined())


def k2_postings_parts(spark, sf):
    """Positions of short, frequent k-mers of whole documents, those in 4,096 characters to a row."""
    rows = kmers.text_postings(_documents(spark, sf), k=2, width=4096)
    return rows.select("id", "kmer", "part", "n", _joined())


def s1_seed_join(spark, sf):
    return seeds.seed_join(_items(spark, sf), _documents(spark, sf), k=11)


def s1_seed_join_stored(spark, sf):
    """The same seeds from a table of the documents' k-mers that is written first, bucketed by k-mer."""
    name = f"kmers_{uuid.uuid4().hex}"
    seeds.store_kmers(_documents(spark, sf), name, 11, scratch_path(spark, "kmers"))
    return seeds.probe(_items(spark, sf), name, 11)


def s1_diagonal_runs(spark, sf):
    return seeds.diagonal_runs(seeds.seed_join(_items(spark, sf), _documents(spark, sf), k=K_SEED))


def s2_extend_seeds(spark, sf):
    q, r = _items(spark, sf), _documents(spark, sf)
    return seeds.extend_seeds(seeds.seed_join(q, r, K_SEED), q, r)


def s3_seed_extend(spark, sf):
    return seeds.seed_extend(_items(spark, sf), _documents(spark, sf), K_SEED)


def s3_seed_extend_dedup(spark, sf):
    return seeds.seed_extend(_items(spark, sf), _documents(spark, sf), K_SEED, dedup=True)


def s4_top_hits(spark, sf):
    return seeds.top_hits(seeds.seed_extend(_items(spark, sf), _documents(spark, sf), K_SEED, dedup=True), 1)


def s5_hit_context(spark, sf):
    r = _documents(spark, sf)
    hits = seeds.seed_extend(_items(spark, sf), r, K_SEED, dedup=True)
    return seeds.hit_context(hits, r).select("query_id", "ref_id", "query_start", "ref_start", "score", "context", "context_offset")


def p1_pattern_count(spark, sf):
    return patterns.pattern_count(_documents(spark, sf), _patterns(spark, sf))


def p2_pattern_locate(spark, sf):
    return patterns.pattern_locate(_documents(spark, sf), _patterns(spark, sf))


def p2_passages(spark, sf):
    """Whole passages, most of several hundred characters, in whole documents."""
    return patterns.pattern_locate(_documents(spark, sf), _items(spark, sf).select(F.col("seq").alias("pattern")))


def p2_overlapping(spark, sf):
    """Short patterns, overlapping occurrences included: each part name's first two characters in all part names."""
    names = _parts(spark, sf)
    return patterns.pattern_locate(names, names.select(F.substring("seq", 1, 2).alias("pattern")))


def p3_pattern_search(spark, sf):
    return patterns.pattern_search(_documents(spark, sf), _patterns(spark, sf)).select("text_id", "pattern", "count", _joined())


def p4_prefix_fallback(spark, sf):
    return patterns.search_with_prefix_fallback(_documents(spark, sf), _patterns(spark, sf)).select("text_id", "pattern", "searched", "used_prefix", "count", _joined())


def p5_match_context(spark, sf):
    texts = _documents(spark, sf)
    return patterns.match_context(patterns.pattern_locate(texts, _patterns(spark, sf)), texts, first=True)


def p6_matched(spark, sf):
    return patterns.matched(_documents(spark, sf), _patterns(spark, sf)).select("id")


def p6_unmatched(spark, sf):
    return patterns.unmatched(_documents(spark, sf), _patterns(spark, sf)).select("id")


def p6_matched_patterns(spark, sf):
    return patterns.matched_patterns(_documents(spark, sf), _patterns(spark, sf))


def p6_unmatched_patterns(spark, sf):
    return patterns.unmatched_patterns(_documents(spark, sf), _patterns(spark, sf))


def b1_rotation_ranks(spark, sf):
    return suffix.rotation_ranks(_parts(spark, sf))


def b1_rotation_ranks_doubling(spark, sf):
    """The route of long texts, on every customer name."""
    return suffix.rotation_ranks(_as(table(spark, sf, "customer"), "c_custkey", "c_name"), short=4)


def b1_rotation_ranks_passages(spark, sf):
    """Whole benchmark passages."""
    return suffix.rotation_ranks(_items(spark, sf))


def b1_rotation_ranks_documents(spark, sf):
    """Whole documents: the rotations' indexes in rank order, those of 4,096 ranks to a row."""
    return suffix.rotation_orders(_documents(spark, sf), 4096).select("text_id", "part", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"))


def b2_bwt_blocks(spark, sf):
    """Whole documents, 1,024 ranks to a block."""
    return suffix.bwt_blocks(_documents(spark, sf), size=1024)


def b2_bwt_passages(spark, sf):
    return suffix.bwt(_items(spark, sf))


def b3_char_table_documents(spark, sf):
    return suffix.char_table(_documents(spark, sf))


def b2_bwt(spark, sf):
    return suffix.bwt(_parts(spark, sf))


def b3_char_table(spark, sf):
    return suffix.char_table(_parts(spark, sf))


def a1_global_score(spark, sf):
    return align.global_score_join(_name_pairs(spark, sf), 2, -1, -2)


def a1_global_score_kernel(spark, sf):
    return align.global_score_join(_name_pairs(spark, sf), 1, -1, -1)


def a1_global_min_score(spark, sf):
    return align.global_score_join(_name_pairs(spark, sf), 1, -1, -1, min_score=1)


def a1_global_pairs(spark, sf):
    """All pairs of customers' names with a global score of 33 or more, which is one edit of 18 characters; no pairs are given."""
    names = _as(table(spark, sf, "customer"), "c_custkey", "c_name")
    return align.global_score_pairs(names, names, 33, 2, -1, -2)


def a3_local_tiles(spark, sf):
    """Local scores of benchmark passages against the whole documents that share a k-mer with them."""
    return _against_documents(spark, sf, align.local_score_join)


def a4_affine_tiles(spark, sf):
    """The same with affine gaps."""
    return _against_documents(spark, sf, align.local_affine_join)


def _against_documents(spark, sf, score):
    items, docs = _items(spark, sf), _documents(spark, sf)
    held = align.candidate_pairs(items, docs, K_SEED).select(F.struct("query_id", "ref_id").alias("pair_id"), "seq1", "seq2")
    return score(held).select("pair_id.query_id", "pair_id.ref_id", "score")


def a2_global_alignments(spark, sf):
    return align.global_alignments(_name_pairs(spark, sf))


def a3_local_score(spark, sf):
    return align.local_score_join(_name_pairs(spark, sf))


def a3_local_alignments(spark, sf):
    return align.local_alignments(_name_pairs(spark, sf), min_score=1)


def a4_affine_score(spark, sf):
    return align.local_affine_join(_name_pairs(spark, sf))


def a3_local_min_score(spark, sf):
    """Names of parts and the next part's with a local score of 14 or more; the others' characters mostly spare the kernel."""
    return align.local_score_join(_name_pairs(spark, sf), min_score=14)


def a4_affine_min_score(spark, sf):
    """The same with affine gaps."""
    return align.local_affine_join(_name_pairs(spark, sf), min_score=14)


def a4_affine_alignments(spark, sf):
    return align.local_affine_alignments(_name_pairs(spark, sf))


def a5_match_line(spark, sf):
    """Customer names, which have one length, against the next customer's."""
    one = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("pair_id"), F.col("c_name").alias("a"))
    two = table(spark, sf, "customer").select((F.col("c_custkey").cast("bigint") - 1).alias("pair_id"), F.col("c_name").alias("b"))
    return one.join(two, "pair_id").select("pair_id", align.match_line(F.col("a"), F.col("b")).alias("line"), align.identity(F.col("a"), F.col("b")).alias("identity"))


def a6_compare_methods(spark, sf):
    """Benchmark passages against the whole documents that share a k-mer with them, by every method."""
    items, docs = _items(spark, sf), _documents(spark, sf)
    pairs = materialize(seeds.seed_join(items, docs, k=K_SEED).select("query_id", "ref_id").distinct(), "pairs")
    return align.compare_methods(items, docs, K_SEED, pairs).select("query_id", "ref_id", "global_score", "local_score", "seed_score", "seed_ref_start", "seed_ref_end", "count", _joined())


QUERIES = {
    f.__name__: f
    for f in (
        k1_kmers, k1_kmers_long, k2_postings, k2_postings_by_id, k2_postings_parts,
        s1_seed_join, s1_seed_join_stored, s1_diagonal_runs, s2_extend_seeds, s3_seed_extend, s3_seed_extend_dedup, s4_top_hits, s5_hit_context,
        p1_pattern_count, p2_pattern_locate, p2_passages, p2_overlapping, p3_pattern_search, p4_prefix_fallback, p5_match_context, p6_matched, p6_unmatched, p6_matched_patterns, p6_unmatched_patterns,
        b1_rotation_ranks, b1_rotation_ranks_doubling, b1_rotation_ranks_passages, b1_rotation_ranks_documents, b2_bwt, b2_bwt_passages, b2_bwt_blocks, b3_char_table, b3_char_table_documents,
        a1_global_score, a1_global_score_kernel, a1_global_min_score, a1_global_pairs, a2_global_alignments, a3_local_score, a3_local_tiles, a3_local_alignments, a3_local_min_score, a4_affine_score, a4_affine_min_score, a4_affine_tiles, a4_affine_alignments, a5_match_line, a6_compare_methods,
    )
}
