"""Seed and extend: shared k-mers, grown without gaps to the best score on their diagonal."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.texts import Known, cut, minimized, packed, place_hashes, slices, unpacked
from ..sources.tables import batch_session, discard, materialize, partitions, scratch_path
from .kmers import LARGE, blocks, bytes_of, hashed, kmers, kmers_among, spread_out, substrings

BROADCAST_CHARS = 2_000_000  # query characters up to which the queries' k-mers are broadcast
CHUNK = 64  # characters of the first round
STRETCH = 512  # and of the last ones
HELD = 2 << 20  # characters of texts whose k-mers are packed at once
ROW = 1 << 20  # characters of a packed row
BUCKET = 64 << 20  # bytes of texts that get a bucket of their k-mers
FILES = 50_000  # of stored k-mers, where that leaves four tasks a core


def seed_join(queries: DataFrame, refs: DataFrame, k: int = 11, max_occ: int | None = None) -> DataFrame:
    """(query_id, ref_id, query_pos, ref_pos): all pairs of equal k-mers of (id, seq) tables.

    The queries' k-mers are broadcast while the queries have at most BROADCAST_CHARS
    characters, so that the references' never move, and their hashes leave most of the references' places without a row; beyond that both sides shuffle by k-mer, and
    frequent ones by a salt too (``salted``). ``max_occ`` leaves out k-mers that occur more often in the
    references; None, the default, loses nothing.
    """
    q, small = _query_kmers(queries, k), _small(queries)
    r = kmers_among(refs, q, k=k) if small else kmers(refs, k=k)
    return _joined(q, r.withColumnsRenamed({"id": "ref_id", "pos": "ref_pos"}), small, max_occ)


def _query_kmers(queries: DataFrame, k: int) -> DataFrame:
    return kmers(queries, k=k).select(F.col("id").alias("query_id"), F.col("pos").alias("query_pos"), "kmer")


def _small(queries: DataFrame) -> bool:
    return (queries.agg(F.sum(F.char_length("seq"))).first()[0] or 0) <= BROADCAST_CHARS


def _joined(q: DataFrame, r: DataFrame, small: bool, max_occ: int | None) -> DataFrame:
    if max_occ is not None:
        common = r.groupBy("kmer").count().where(F.col("count") > max_occ).select("kmer")
        q = q.join(common, "kmer", "left_anti")
    if small:
        return r.join(F.broadcast(q), "kmer").select("query_id", "ref_id", "query_pos", "ref_pos")
    q, r = salted(q, r)
    return r.join(q, ["kmer", "salt"]).select("query_id", "ref_id", "query_pos", "ref_pos")


def salted(q: DataFrame, r: DataFrame, kinds: int = 1 << 16, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: rows of frequent k-mers are dealt out on the reference side and repeated on the query side.

    Counts decide, by hash of the k-mer in ``kinds`` groups: one pass whose map side leaves ``kinds`` rows.
    A group of more than one in ``share`` of all rows is frequent, so there are fewer than ``share`` of them, and
    gets as many salts as it has such parts: no salt of a frequent k-mer has more than that of the references.
    """
    kind = lambda: F.pmod(F.xxhash64("kmer"), F.lit(kinds)).cast("int").alias("kind")
    counts = r.groupBy(kind()).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") * share > total).select("kind", F.ceil(F.col("n") * share / F.lit(max(1, total))).cast("int").alias("salts"))
    parts = F.coalesce("salts", F.lit(1))
    dealt = r.withColumn("kind", kind()).join(F.broadcast(heavy), "kind", "left").withColumn("salt", F.pmod(F.xxhash64("ref_id", "ref_pos"), parts).cast("int"))
    each = q.withColumn("kind", kind()).join(F.broadcast(heavy), "kind", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return each.drop("kind", "salts"), dealt.drop("kind", "salts")


def _core(k: int) -> int:
    """Characters of the minimizer by which a k-mer is stored."""
    return max(1, (k + 1) // 2)


def _bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of ``n`` buckets of a table that Spark buckets by such numbers."""
    numbers = spark.range(32 * n).select(F.col("id").cast("int").alias("part"))
    held = numbers.groupBy(F.pmod(F.hash("part"), F.lit(n))).agg(F.min("part").alias("part"))
    return np.sort(held.toArrow().column("part").to_numpy())


def _key_of(least: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The bucket key of each minimizer's hash."""
    return keys[((least ^ least >> np.uint64(32)) % np.uint64(len(keys))).astype(np.int64)]


def _packed_runs(refs: DataFrame, k: int, keys: np.ndarray) -> DataFrame:
    """(part, k, ids, starts, counts, packed, size): runs of neighbouring k-mers with one minimizer, those of a bucket and of some texts as a row.

    A run is the joint piece of text of its k-mers. ``packed`` has a row's pieces and their places, ``counts`` in each block of text, which
    begins at a place of ``starts`` of the text that ``ids`` tells; no row has over ROW characters. Each k-mer is in one run.
    """
    columns = ["part", "k", "ids", "starts", "counts", "packed", "size"]
    id_type = refs.schema["id"].dataType.simpleString()

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        texts, ids, starts, *found = (list(x) for x in zip(*held, strict=True))
        chars, rows = (np.cumsum([0, *map(len, x)]) for x in (texts, ids))
        begin, row = (np.concatenate([x + first for x, first in zip(found[i], before, strict=False)]) for i, before in ((0, chars), (3, rows)))
        pos, length, part = (np.concatenate(found[i]) for i in (1, 2, 4))
        order = np.argsort(part, kind="stable")
        begin, pos, length, row, part = (x[order] for x in (begin, pos, length, row, part))
        differs = lambda x: np.append(True, x[1:] != x[:-1])
        new = differs(part) | differs((np.cumsum(length) - 1) // ROW)
        head = new | differs(row)
        gap = np.where(head, pos, np.diff(pos, prepend=0))
        lo, head, codes = np.flatnonzero(new), np.flatnonzero(head), np.concatenate(texts)
        data, sizes = zip(*(packed(codes, begin[i:j], length[i:j], gap[i:j]) for i, j in zip(lo, np.append(lo[1:], len(part)), strict=True)), strict=True)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(head, lo), len(head)), pa.int32()), x)
        ids, starts = (pa.concat_arrays(x).take(pa.array(row[head])) for x in (ids, starts))
        counts = pa.array(np.diff(np.append(head, len(part))), pa.int32())
        rest = [pa.array(part[lo], pa.int32()), pa.array(np.full(len(lo), k), pa.int32()), lists(ids), lists(starts), lists(counts)]
        return pa.RecordBatch.from_arrays([*rest, pa.array(data, pa.binary()), pa.array(sizes, pa.int32())], columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:
            for rows, codes, starts in slices(b, "blk"):
                begin, length, _, least = minimized(codes, starts, k, _core(k))
                row = np.searchsorted(starts, begin, "right") - 1
                held.append((codes, rows.column("id"), rows.column("start"), begin, begin - starts[row], length, row, _key_of(least, keys)))
                chars += len(codes)
                if chars >= HELD:
                    yield rows_of(held)
                    held, chars = [], 0
        if chars:
            yield rows_of(held)

    pieces = blocks(spread_out(refs.select("id", "seq")), "id", "seq", k, LARGE)
    return pieces.mapInArrow(work, f"part int, k int, ids array<{id_type}>, starts array<bigint>, counts array<int>, packed binary, size int")


def _opened(b: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(id, pos, begin, codes) of the runs in a row of ``_packed_runs``: their texts and places, their characters, and where each one's begin, with their end."""
    ids, starts, counts = (b.column(x)[i].values for x in ("ids", "starts", "counts"))
    counts = counts.to_numpy()
    gap, begin, codes = unpacked(b.column("packed")[i].as_py(), b.column("size")[i].as_py(), int(counts.sum()))
    total, head = np.cumsum(gap), np.cumsum(counts) - counts
    pos = total + np.repeat(starts.to_numpy() - total[head] + gap[head], counts)
    return ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pos, begin, codes


def _places(begin: np.ndarray, codes: np.ndarray, k: int, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, run, hash) of the runs' k-mers that have a known hash."""
    hashes = place_hashes(codes, [k])[k]
    at = known.among(hashes)
    run = np.searchsorted(begin, at, "right") - 1
    inside = at + k <= begin[run + 1]
    at, run = at[inside], run[inside]
    return at, run, hashes[at]


def _opened_runs(rows: DataFrame) -> DataFrame:
    """(ref_id, ref_pos, piece) of rows of ``_packed_runs``."""
    id_type = rows.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, pos, begin, codes = _opened(b, i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos), cut(codes, begin[:-1], np.diff(begin))], ["ref_id", "ref_pos", "piece"])

    return rows.mapInArrow(work, f"ref_id {id_type}, ref_pos bigint, piece string")


def kmer_runs(refs: DataFrame, k: int) -> DataFrame:
    """(ref_id, ref_pos, piece): neighbouring k-mers with one minimizer, their joint piece of text as a row. Each k-mer is in one of them."""
    return _opened_runs(_packed_runs(refs, k, np.zeros(1, dtype=np.int32)))


def store_kmers(refs: DataFrame, name: str, k: int = 11, path: str | None = None) -> None:
    """Write the references' k-mers once, as table ``name`` of packed ``kmer_runs`` bucketed by minimizer, for later ``probe``s.

    Each task writes its runs to files of its own for the buckets, and nothing is shuffled but texts that are too few for all cores. There is a
    bucket for every BUCKET bytes of texts, within the session's shuffle partitions, and tasks are joined where files would be more than FILES.
    ``path``: its folder, if not the warehouse. k-mers of another length than the table's find nothing there.
    """
    spark = refs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = min(partitions(spark), max(cores, bytes_of(refs.select("id", "seq")) // BUCKET))
    writer = _packed_runs(refs, k, _bucket_keys(spark, n)).coalesce(max(cores * 4, FILES // n)).write.bucketBy(n, "part").option("compression", "zstd")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def probe(queries: DataFrame, name: str, k: int = 11, max_occ: int | None = None) -> DataFrame:
    """As ``seed_join``, with the references' k-mers of a table by ``store_kmers``: their side is neither cut again nor moved.

    Up to BROADCAST_CHARS characters of queries, their k-mers are broadcast and looked up in all runs; beyond it they move to the runs' buckets. With
    ``max_occ`` the references' k-mers are counted and move then, too.
    """
    q, small = _query_kmers(queries, k), _small(queries)
    spark = batch_session(queries.sparkSession)
    spark.catalog.setCurrentDatabase(queries.sparkSession.catalog.currentDatabase())
    r = spark.table(name).where(F.col("k") == k)
    if small:
        return _joined(q, _among(r, q, k), True, max_occ)
    if max_occ is not None:
        each = _opened_runs(r.drop("part")).select("ref_id", "ref_pos", F.posexplode(substrings(F.col("piece"), k)).alias("off", "kmer"))
        return _joined(q, each.select("ref_id", (F.col("ref_pos") + F.col("off")).alias("ref_pos"), "kmer"), False, max_occ)
    return _met(r, q, k, int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"]))


def _among(r: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(ref_id, ref_pos, kmer): the stored k-mers that are among the queries', and hardly any others."""
    keys = q.select("kmer").distinct().select(hashed(F.col("kmer")).alias("key")).toArrow().column("key")
    known = q.sparkSession.sparkContext.broadcast(Known(keys.to_numpy()))
    id_type = r.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, pos, begin, codes = _opened(b, i)
                at, run, _ = _places(begin, codes, k, known.value)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(run)), pa.array(pos[run] + at - begin[run]), cut(codes, at, np.full(len(at), k))], ["ref_id", "ref_pos", "kmer"])

    return r.select("ids", "starts", "counts", "packed", "size").mapInArrow(work, f"ref_id {id_type}, ref_pos bigint, kmer string")


def _met(r: DataFrame, q: DataFrame, k: int, n: int) -> DataFrame:
    """The seeds of any number of queries: those of a bucket move to it as one row, and stored rows look their k-mers up in it."""
    keys = _bucket_keys(r.sparkSession, n)
    id_type = r.schema["ids"].dataType.elementType.simpleString()

    @F.arrow_udf("int")
    def bucket(texts: pa.Array) -> pa.Array:
        found = [_key_of(minimized(codes, starts, k, _core(k))[3], keys) for _, codes, starts in slices(pa.record_batch({"t": texts}), "t")]  # a run for each, as each is one k-mer
        return pa.array(np.concatenate(found) if found else np.empty(0), pa.int32())

    @F.arrow_udf(f"array<struct<no: int, ref_id: {id_type}, ref_pos: bigint>>")
    def places(ids: pa.Array, starts: pa.Array, counts: pa.Array, packed: pa.Array, size: pa.Array, asked: pa.Array) -> pa.Array:
        b, found = pa.record_batch({"ids": ids, "starts": starts, "counts": counts, "packed": packed, "size": size}), []
        for i in range(b.num_rows):
            held, pos, begin, codes = _opened(b, i)
            wanted = asked[i].values
            own = place_hashes(np.frombuffer("".join(wanted.to_pylist()).encode("utf-32-le"), dtype=np.uint32), [k])[k][::k]
            order = np.argsort(own, kind="stable")
            at, run, hashes = _places(begin, codes, k, Known(own))
            lo, hi = (np.searchsorted(own[order], hashes, side) for side in ("left", "right"))
            at, run, lo, several = (np.repeat(x, hi - lo) for x in (at, run, lo, np.cumsum(hi - lo) - (hi - lo)))
            no = order[lo + np.arange(len(lo)) - several]
            same = pc.equal(wanted.take(pa.array(no)), cut(codes, at, np.full(len(at), k))).to_numpy(zero_copy_only=False)
            at, run, no = at[same], run[same], no[same]
            found.append(pa.StructArray.from_arrays([pa.array(no, pa.int32()), held.take(pa.array(run)), pa.array(pos[run] + at - begin[run])], ["no", "ref_id", "ref_pos"]))
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays(found) if found else pa.array([], pa.struct([("no", pa.int32()), ("ref_id", ids.type.value_type), ("ref_pos", pa.int64())])))

    moved = q.withColumn("part", bucket("kmer")).repartition(n, "part")
    each = moved.groupBy("part", "kmer").agg(F.collect_list(F.struct("query_id", "query_pos")).alias("hits"))
    wanted = each.groupBy("part").agg(F.collect_list(F.struct("kmer", "hits")).alias("wanted"))
    met = r.join(wanted, "part").select("wanted", F.explode(places("ids", "starts", "counts", "packed", "size", "wanted.kmer")).alias("p"))
    seeds = met.select("p", F.explode(F.get("wanted", F.col("p.no"))["hits"]).alias("h"))
    return seeds.select("h.query_id", "p.ref_id", "h.query_pos", "p.ref_pos")


def diagonal_runs(seeds: DataFrame) -> DataFrame:
    """(query_id, ref_id, query_pos, ref_pos, n_seeds): seeds at consecutive places of one diagonal, as their first."""
    w = Window.partitionBy("query_id", "ref_id", "_diag").orderBy("query_pos")
    marked = seeds.withColumn("_diag", F.col("ref_pos") - F.col("query_pos")).withColumn("_run", F.col("query_pos") - F.dense_rank().over(w))
    runs = marked.groupBy("query_id", "ref_id", "_diag", "_run").agg(F.min("query_pos").alias("query_pos"), F.count("*").alias("n_seeds"))
    return runs.select("query_id", "ref_id", "query_pos", (F.col("query_pos") + F.col("_diag")).alias("ref_pos"), "n_seeds")


def addressed(texts: DataFrame, ids: DataFrame, label: str) -> str:
    """The name of a table (id, no, blk) of the texts among ``ids`` (id): block ``no`` begins at place no * STRETCH and has twice as many characters.

    So each stretch of up to STRETCH characters lies in the block of its first place. The table is bucketed
    by (id, no) and lies in the shared folder: a round's join moves its other side only.
    """
    spark = texts.sparkSession
    held = texts.select("id", "seq").join(ids, "id", "left_semi")
    cut = blocks(held, "id", "seq", 1, STRETCH, STRETCH + 1).select("id", (F.col("start") / STRETCH).cast("bigint").alias("no"), "blk")
    name = f"seqloom_{label}_{uuid.uuid4().hex}"
    n = partitions(spark)
    cut.repartition(n, "id", "no").write.bucketBy(n, "id", "no").sortBy("id", "no").option("path", scratch_path(spark, label)).saveAsTable(name)
    return name


def _fetched(state: DataFrame, blocks_of: str, id: str, start: Column, length: Column, name: str) -> DataFrame:
    """``state`` with ``name``, the ``length`` characters of its text at ``start``; null behind the text's end."""
    held = state.sparkSession.table(blocks_of).select(F.col("id").alias("_id"), F.col("no").alias("_no"), "blk")
    no = F.floor(start / STRETCH).cast("bigint")
    asked = state.withColumn("_n", no)
    full = asked.join(held, (F.col(id) == F.col("_id")) & (F.col("_n") == F.col("_no")), "left")
    return full.withColumn(name, F.substring(F.col("blk"), (start - F.col("_n") * STRETCH + 1).cast("int"), length)).drop("_id", "_no", "_n", "blk")


def _grow(state: DataFrame, queries: str, refs: str, right: bool, match: int, mismatch: int, xdrop: int) -> DataFrame:
    """Carry (score, best, best_off) of each run to its end on one side, a chunk of offsets at a time.

    A round fetches one block of each text, that of the chunk. Runs that dropped or reached a text's end leave, and
    chunks double up to STRETCH.
    """
    kept = ["query_id", "ref_id", "query_pos", "ref_pos", "n_seeds", "best_right"]
    state = state.select(*kept, F.col("best").cast("bigint").alias("score"), F.col("best").cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("best_off"), F.lit(0).cast("bigint").alias("off"))
    ended, chunk = [], CHUNK
    while True:
        if right:
            length = F.lit(chunk)
            begin = lambda pos: F.col(pos) + F.col("off")
            turn = lambda text: F.coalesce(text, F.lit(""))
        else:
            length = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(chunk).cast("bigint"), F.least("query_pos", "ref_pos") - F.col("off"))).cast("int")
            begin = lambda pos: F.col(pos) - F.col("off") - length
            turn = lambda text: F.reverse(F.coalesce(text, F.lit("")))
        both = _fetched(_fetched(state, queries, "query_id", begin("query_pos"), length, "_q"), refs, "ref_id", begin("ref_pos"), length, "_r")
        n = F.least(F.char_length(turn(F.col("_q"))), F.char_length(turn(F.col("_r"))))
        pairs = both.select(*state.columns, n.alias("_n"), F.arrays_zip(F.split(turn(F.col("_q")), "").alias("a"), F.split(turn(F.col("_r")), "").alias("b")).alias("_z"))

        def step(s, z):
            score = s["score"] + F.when(z["a"] == z["b"], F.lit(match)).otherwise(F.lit(mismatch))
            better = score > s["best"]
            best = F.greatest(score, s["best"])
            new = F.struct(score.alias("score"), best.alias("best"), F.when(better, s["i"] + 1).otherwise(s["best_off"]).alias("best_off"), (s["i"] + 1).alias("i"), (score < best - xdrop).alias("dropped"))
            return F.when(s["dropped"], s).otherwise(new)

        start = F.struct(F.col("score"), F.col("best"), F.col("best_off"), F.col("off").alias("i"), F.lit(False).alias("dropped"))
        moved = pairs.withColumn("_s", F.aggregate(F.slice("_z", F.lit(1), F.col("_n")), start, step))
        done = materialize(moved.select(*kept, "_s.score", "_s.best", "_s.best_off", F.col("_s.i").alias("off"), (F.col("_s.dropped") | (F.col("_n") < chunk)).alias("_done")), "extended")
        ended.append(done.where("_done").drop("_done"))
        state = done.where("not _done").drop("_done")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        chunk = min(chunk * 2, STRETCH)


def extend_seeds(seeds: DataFrame, queries: DataFrame, refs: DataFrame, match: int = 1, mismatch: int = -1, xdrop: int = 5) -> DataFrame:
    """(query_id, ref_id, query_pos, ref_pos, n_seeds, query_start, query_end, ref_start, ref_end, score).

    Growth without gaps, right from the seed's start, then left from the best score found;
    the first offset of a strictly greater score counts, and a side ends where the score is
    more than ``xdrop`` below the best. For match > 0 the seeds of a diagonal run have the same
    hit, so one row per run is grown and ``n_seeds`` tells how many it stands for. The texts that have
    seeds are stored as blocks once, and no row of a round has more of a text than a block.
    """
    spark = queries.sparkSession
    runs = diagonal_runs(seeds) if match > 0 and mismatch <= match else seeds.withColumn("n_seeds", F.lit(1).cast("bigint"))
    runs = runs.withColumn("best", F.lit(0)).withColumn("best_right", F.lit(0).cast("bigint"))
    runs = materialize(runs, "runs")
    q, r = (addressed(texts, runs.select(F.col(f"{name}_id").alias("id")).distinct(), name) for texts, name in ((queries, "query"), (refs, "ref")))
    rightward = _grow(runs, q, r, True, match, mismatch, xdrop).withColumn("best_right", F.col("best_off"))
    both = _grow(rightward, q, r, False, match, mismatch, xdrop)
    for name in (q, r):
        where = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        discard(where)
    at = lambda pos: ((F.col(pos) - F.col("best_off")).cast("bigint"), (F.col(pos) + F.col("best_right")).cast("bigint"))
    (qs, qe), (rs, re) = at("query_pos"), at("ref_pos")
    return both.select("query_id", "ref_id", "query_pos", "ref_pos", "n_seeds", qs.alias("query_start"), qe.alias("query_end"), rs.alias("ref_start"), re.alias("ref_end"), F.col("best").alias("score"))


def seed_extend(queries: DataFrame, refs: DataFrame, k: int = 11, dedup: bool = False, match: int = 1, mismatch: int = -1, xdrop: int = 5) -> DataFrame:
    """Hits of ``queries`` in ``refs``: ids, seed, the seven hit fields and n_seeds.

    One row per seed; with ``dedup`` one per distinct hit, with its number of seeds and first
    seed. The order (score descending, then seed) is left to the caller's sort or ``top_hits``.
    """
    hits = extend_seeds(seed_join(queries, refs, k), queries, refs, match, mismatch, xdrop)
    if dedup:
        hit = ["query_id", "ref_id", "query_start", "query_end", "ref_start", "ref_end", "score"]
        first = F.min(F.struct("query_pos", "ref_pos"))
        hits = hits.groupBy(*hit).agg(first.alias("_f"), F.sum("n_seeds").alias("n_seeds")).select(*hit, "_f.query_pos", "_f.ref_pos", "n_seeds")
    else:
        hits = hits.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_seeds") - 1))).withColumn("query_pos", F.col("query_pos") + F.col("_i")).withColumn("ref_pos", F.col("ref_pos") + F.col("_i")).drop("_i").withColumn("n_seeds", F.lit(1).cast("bigint"))
    texts = hits.join(queries.select(F.col("id").alias("query_id"), F.col("seq").alias("_q")), "query_id").join(refs.select(F.col("id").alias("ref_id"), F.col("seq").alias("_r")), "ref_id")
    part = lambda text, side: F.substring(F.col(text), (F.col(f"{side}_start") + 1).cast("int"), (F.col(f"{side}_end") - F.col(f"{side}_start")).cast("int"))
    return texts.select("query_id", "ref_id", "query_pos", "ref_pos", "query_start", "query_end", "ref_start", "ref_end", "score", part("_q", "query").alias("query_seq"), part("_r", "ref").alias("ref_seq"), "n_seeds")


def top_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """The best n hits of each query; ties by seed and reference."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "query_pos", "ref_pos", "ref_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hit_context(hits: DataFrame, refs: DataFrame, flank: int = 5) -> DataFrame:
    """Hits with the reference's text around them (``context``) and the hit's offset in it (``context_offset``)."""
    r = refs.select(F.col("id").alias("ref_id"), F.col("seq").alias("_r"))
    start = F.greatest(F.lit(0), F.col("ref_start") - flank)
    end = F.least(F.char_length("_r"), F.col("ref_end") + flank)
    return hits.join(r, "ref_id").withColumn("context", F.substring(F.col("_r"), (start + 1).cast("int"), (end - start).cast("int"))).withColumn("context_offset", (F.col("ref_start") - start).cast("bigint")).drop("_r")
