"""K-mer tables: every substring of length k with its position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import MET, Known, cut, grouped, hash_of, met, slices
from ..sources.tables import by_repeats

BLOCK = 128
LARGE = 1 << 14  # characters of a block whose places are looked up at once


def blocks(df: DataFrame, id: str, seq: str, k: int, block: int = BLOCK, reach: int | None = None) -> DataFrame:
    """(id, start, blk): the text in pieces of ``block`` characters, each with what its k-mers reach beyond it.

    ``substring`` walks a text from its beginning, so positions are cut from short pieces, and
    the pieces come from one pass of a regular expression, which looks ahead by ``reach`` - 1 characters
    (k - 1 if not given): linear in the text's length. Pieces without a k-mer are left out.
    """
    size = max(block, k)
    whole = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{size + (reach or k) - 1}}})).{{1,{size}}}"), F.lit(1))
    pieces = df.where(F.char_length(seq) >= k).select(F.col(id).alias("id"), F.posexplode(whole).alias("i", "blk"))
    return pieces.where(F.char_length("blk") >= k).select("id", (F.col("i").cast("bigint") * size).alias("start"), "blk")


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of the table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` dealt out to four tasks a core, unless its size by Spark's estimate gives every core a partition anyway."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if bytes_of(df) >= cores * split else df.repartition(cores * 4)


def substrings(text: Column, k: int) -> Column:
    """array<string>: all substrings of length k, by a look-ahead at every place: one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def kmers(df: DataFrame, id: str = "id", seq: str = "seq", k: int = 11) -> DataFrame:
    """(id, pos, kmer): positions from 0, in code points; texts shorter than k and nulls give no rows.

    Texts of few partitions are dealt out first, as one small file would otherwise be one task.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    cut = blocks(spread_out(df.select(id, seq)), id, seq, k).select("id", "start", F.posexplode(substrings(F.col("blk"), k)).alias("off", "kmer"))
    return cut.select("id", (F.col("start") + F.col("off")).alias("pos"), "kmer")


def hashed(text: Column) -> Column:
    """The hash by which ``met_places`` knows a text."""

    @F.arrow_udf("bigint")
    def told(texts: pa.Array) -> pa.Array:
        return hash_of(texts)

    return told(text)


def met_places(df: DataFrame, wanted: DataFrame, reach: dict[int, int], id: str = "id", seq: str = "seq") -> DataFrame:
    """(id, pos, n, key, piece): the texts' places where ``n`` characters have a hash of ``wanted`` (n, key), with ``reach[n]`` characters from there.

    Other places make no row. The hashes, 8 bytes each, pass through the driver: callers bound their number. Who
    needs the characters themselves compares ``piece``.
    """
    got = wanted.select("n", "key").distinct().toArrow()
    n, key = got.column("n").to_numpy(), got.column("key").to_numpy()
    known = df.sparkSession.sparkContext.broadcast({int(x): Known(key[n == x]) for x in np.unique(n)})

    @F.arrow_udf(MET)
    def places(texts: pa.Array) -> pa.Array:
        return met(texts, known.value, reach)

    pieces = blocks(spread_out(df.select(id, seq)), id, seq, min(reach), LARGE, max(reach.values()))
    found = pieces.select("id", "start", F.explode(places("blk")).alias("p")).where(F.col("p.at") < LARGE)
    return found.select("id", (F.col("start") + F.col("p.at")).alias("pos"), "p.n", "p.key", "p.piece")


def kmers_among(df: DataFrame, wanted: DataFrame, id: str = "id", seq: str = "seq", k: int = 11) -> DataFrame:
    """(id, pos, kmer): as ``kmers``, those that are among ``wanted`` (kmer), and hardly any others."""
    keys = wanted.select("kmer").distinct().select(F.lit(k).alias("n"), hashed(F.col("kmer")).alias("key"))
    return met_places(df, keys, {k: k}, id, seq).select("id", "pos", F.col("piece").alias("kmer"))


def kmer_postings(rows: DataFrame, by_id: bool = False, width: int | None = None) -> DataFrame:
    """(kmer[, id][, part], n, positions): positions ascending; ``n`` is their number.

    With ``width``, which asks for ``by_id``, a row has the positions of ``width`` characters of one
    text (``part`` counts them from 0), so that no row grows with a k-mer's frequency.
    """
    if width is not None and (width < 1 or not by_id):
        raise ValueError("width must be 1 or more, and goes with by_id")
    keys = ["kmer", "id"] if by_id else ["kmer"]
    if width is not None:
        rows, keys = rows.withColumn("part", F.floor(F.col("pos") / width).cast("bigint")), [*keys, "part"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))


def text_postings(df: DataFrame, id: str = "id", seq: str = "seq", k: int = 11, width: int = 4096) -> DataFrame:
    """(kmer, id, part, n, positions): ``kmer_postings`` of the texts' k-mers by id in parts of ``width`` characters.

    A part's k-mers are gathered in the task that has its characters, and none is shuffled. Texts
    whose id repeats, whose parts are gathered together, go by rows of k-mers.
    """
    columns = ["kmer", "id", "part", "n", "positions"]
    named = df.select(F.col(id).alias("id"), F.col(seq).alias("seq"))
    if width < k:
        return kmer_postings(kmers(named, k=k), True, width).select(*columns)
    single, several = by_repeats(named, "id")
    id_type = named.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, codes, starts in slices(b, "blk"):
                begin = rows.column("start").to_numpy()
                row, at, n = grouped(codes, starts, k)
                first = np.cumsum(n) - n
                held = rows.column("id").take(pa.array(row[first]))
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(begin[row] + at - starts[row]))
                yield pa.RecordBatch.from_arrays([cut(codes, at[first], np.full(len(first), k)), held, pa.array(begin[row[first]] // width), pa.array(n), positions], columns)

    pieces = blocks(spread_out(single), "id", "seq", k, width)
    found = pieces.mapInArrow(gather, f"kmer string, id {id_type}, part bigint, n bigint, positions array<bigint>")
    return found if several is None else found.unionByName(kmer_postings(kmers(several, k=k), True, width).select(*columns))
