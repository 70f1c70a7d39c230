"""Token-id output as Parquet list columns.

Documents are dealt out by ranges of doc_id, sorted, encoded and written with Spark's
Parquet writer: dictionary pages, or delta-packed integers; row groups and pages of a set
size; page indexes beside the data, so that a reader of a few documents or of the counts
alone skips the other pages and columns. Every row holds where its tokens start in its
file; where a file starts among all follows from the files' counts, one row per file.

A batch of texts is split into words by Arrow and its distinct words are encoded by the
tokenizers library, which a worker remembers; all words then gather their ids at once. A text
is cut only at blanks that the vocabulary's normaliser drops, so the ids are those of the whole.

Defined results
- null and empty texts: the end id alone;
- null doc_id: before all others; rows of one doc_id: in order of their texts;
- empty table: files without rows, an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import partitions, quantile_bounds, range_bucket

MEMO = 600_000  # words remembered by a worker
CHUNK_BYTES = 3 << 20  # of texts that are encoded at once: as many as it takes to reach them


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Latin letters with ASCII marks behind them: two pre-tokens at most, no text of a special token.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _letters(path: str) -> dict[int, str] | None:
    """How the vocabulary spells a Latin letter, if its normaliser and pre-tokenizer are those that treat letters alike.

    Composition and lower-casing change a Latin letter among Latin letters by itself, the
    split takes a run of letters whole, and bytes are spelt by the byte-level alphabet: printable ones
    as themselves and the others, in order, by the characters from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    kinds = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and "|[\\p{L}]+|" in str(splits[0]["pattern"].get("Regex"))
    if not known:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    spelt = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(others)}
    return {ord(c): "".join(spelt[x] for x in c.lower().encode()) for c in map(chr, range(256)) if _LATIN.fullmatch(c)}


class WordEncoder:
    """Ids of a column of texts: the batch's distinct words are encoded, all words gather their ids."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.letters = _letters(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        """The word of number w has the ids ``self.ids[self.ends[w] : self.ends[w + 1]]``."""
        self.number: dict[str, int] = {}
        self.ends, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; those not seen before go through the tokenizer."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unseen = np.flatnonzero(number < 0)
        if len(unseen):
            new = [words[i] for i in unseen]
            got: list[list[int]] = [[]] * len(new)
            rest = []
            for i, w in enumerate(new):
                if self.letters is not None and _LATIN.fullmatch(w):
                    got[i] = [t.id for t in self.model.tokenize(w.translate(self.letters))]
                else:
                    rest.append(i)
            for lo in range(0, len(rest), 20_000):
                part = rest[lo : lo + 20_000]
                for i, e in zip(part, self.tokenizer.encode_batch_fast([new[i] for i in part], add_special_tokens=False), strict=True):
                    got[i] = e.ids
            number[unseen] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, number[unseen].tolist(), strict=True))
            self.ids = np.concatenate((self.ids, np.array([i for g in got for i in g], dtype=np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(g) for g in got], dtype=np.int64)))
        return number

    def _parts(self, words: pa.StringArray) -> np.ndarray:
        """Two numbers for each word: of its letters and of the marks behind them, or of the whole and of nothing."""
        told = pc.extract_regex(words, _SIMPLE)
        simple = pc.is_valid(told)
        letters = pc.if_else(simple, pc.ascii_lower(pc.struct_field(told, "letters")), words)
        marks = pc.if_else(simple, pc.struct_field(told, "marks"), "")
        out = []
        for part in (letters, marks):
            different = part.dictionary_encode()
            numbers = self._numbers(different.dictionary.to_numpy(zero_copy_only=False).tolist())
            out.append(numbers[different.indices.to_numpy()])
        return np.stack(out, axis=1)

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): how many ids each text has with its end id, and all of them in a row."""
        if len(self.number) > MEMO:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        # what the splitting leaves before a first and after a last blank is the empty word, of no ids
        if self.letters is not None:
            number = self._parts(words.dictionary)[words.indices.to_numpy()].ravel()
        else:
            number = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        width = len(number) // max(1, len(words))
        length = self.ends[number + 1] - self.ends[number]
        stop = np.cumsum(length)
        ids = self.ids[np.repeat(self.ends[number] - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)]
        upto = np.concatenate(([0], stop))[width * np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))))]
        return np.diff(upto) + 1, np.insert(ids, upto[1:], end_id)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One per worker, so that its memory outlives a task."""
    return WordEncoder(path)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until a column holds ``least`` bytes: more rows share the work on their words."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, files: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write (doc_id, local_start, n_tokens, ids, part) in ascending doc_id order, a file per range.

    ``encoding``: "dictionary" (with plain pages where a dictionary does not pay) or "delta".
    Only the texts are shuffled, once; the cut points are bounded by ``files``.
    """
    spark = docs.sparkSession
    n = files or partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bucket = range_bucket(F.col("doc_id"), quantile_bounds(rows, F.col("doc_id"), n))
    dealt = rows.repartitionById(n, bucket.cast("int")).sortWithinPartitions("doc_id", "text")

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = _encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in _gathered(batches, 1, CHUNK_BYTES):
            counts, ids = encoder.encode(b.column(1), end_id)
            ends = np.cumsum(counts)
            starts = at + ends - counts
            at += int(ends[-1]) if len(ends) else 0
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(counts), listed, pa.array(np.full(len(counts), part, dtype=np.int32))], names=["doc_id", "local_start", "n_tokens", "ids", "part"])

    held = dealt.mapInArrow(to_ids, "doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>, part int")
    delta = {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"} if encoding == "delta" else {"parquet.enable.dictionary": "true"}
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": "5000", "compression": "zstd"} | delta
    held.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts all tokens of the files and rows before.

    The counts alone are read to place the files; a row per file is broadcast.
    """
    rows = spark.read.schema("doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>, part int").parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents; ordered doc_ids let the page indexes leave out the other pages."""
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path)
    return rows.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def read_token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the tokens from ``start`` to ``stop`` - 1 of all files in a row, documents on the ends cut.

    A row per file says which files hold the range, of which only the first and the last come to the driver; the files' numbers
    leave out all others, and in the last one the page indexes leave out what begins behind the range.
    """
    rows = spark.read.schema("doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>, part int").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    held = totals.where((F.col("base") < stop) & (F.col("base") + F.col("n") > start))
    ends = held.agg(F.min_by(F.struct("part", "base"), "part").alias("first"), F.max_by(F.struct("part", "base"), "part").alias("last")).first()
    if ends["first"] is None:
        return rows.where("false").select("doc_id", F.col("local_start").alias("start"), "ids")
    (first, before_first), (last, before_last) = ends["first"], ends["last"]
    # bases ascend with the parts, so that only the first and the last file are cut, and a file's own base comes by a join
    begins = (F.col("part") > first) | (F.col("local_start") + F.col("n_tokens") > start - before_first)
    ceases = (F.col("part") < last) | (F.col("local_start") < stop - before_last)
    inside = rows.where(F.col("part").between(first, last) & begins & ceases).join(F.broadcast(held.select("part", "base")), "part")
    base = F.col("base")
    at = base + F.col("local_start")
    skip = F.greatest(F.lit(0).cast("bigint"), start - at)
    take = F.least(F.col("n_tokens"), stop - at) - skip
    return inside.select("doc_id", (at + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of the ids as little-endian 32-bit integers."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            raw = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).tobytes()
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) * 4
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
