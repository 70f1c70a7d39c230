import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from seqloom.llm import tokenfiles
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, part int, ids string"
TEXTS = [None, "", "  \n", "Hello World's café", "é ́x y z\x1cq", "ΑΣ ΣΑΣ. ΌΔΟΣ", "<|endoftext|> a<|startoftext|>", "it's we'll 12 345!!", "漢字 🦆🦆\tx\x0by", "İstanbul ŉ ǰ", "a" * 500]


def expected(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_the_librarys_ids(spark, tmp_path, encoding):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS * 4)] + [(None, "x"), (4, "a"), (4, "a"), (4, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)
    path = str(tmp_path / encoding)
    tokenfiles.write_token_files(df, path, PATH, encoding=encoding, files=5, row_group_bytes=1 << 20)
    got = tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
    kinds = set()
    for f in (tmp_path / encoding).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        if meta.num_rows:
            column = meta.row_group(0).column(3)
            assert column.has_column_index or column.has_offset_index
            kinds |= set(column.encodings)
    assert ("DELTA_BINARY_PACKED" in kinds) == (encoding == "delta")


def test_selective_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word {i}", 1, "x") for i in range(500)], DOCS)
    path = str(tmp_path / "t")
    tokenfiles.write_token_files(df, path, PATH, files=4)
    counts = tokenfiles.read_token_files(spark, path).select("start")
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert tokenfiles.read_token_files(spark, path).where("doc_id = 77").count() == 1


def scanned(df):
    """Rows that the scan of an executed plan gave."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_readers_skip_pages_and_cut_ranges(spark, tmp_path):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit(1).alias("part"), F.lit("x").alias("ids"))
    path = str(tmp_path / "p")
    tokenfiles.write_token_files(df, path, PATH, files=2, page_bytes=2048)
    few = tokenfiles.read_documents(spark, path, [77, 15_000])
    assert sorted(few._jdf.collectAsList().size() for _ in range(1)) == [2] and scanned(few) < n
    rows = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    every = [i for r in rows for i in r.ids]
    for start, stop in ((0, 5), (rows[3].start + 1, rows[700].start + 2), (rows[9_990].start, rows[10_010].start), (len(every) - 3, len(every) + 9), (7, 7)):
        got = tokenfiles.read_token_range(spark, path, start, stop).orderBy("start").collect()
        assert [i for r in got for i in r.ids] == every[start:stop]
        assert not got or got[0].start == start


def test_empty(spark, tmp_path):
    path = str(tmp_path / "e")
    tokenfiles.write_token_files(spark.createDataFrame([], DOCS), path, PATH)
    assert tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path)).count() == 0
