import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from seqloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
EXACT = tiktoken.Encoding("exact", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "a", "it's we'll '", "\n\n  x \t", "<|endoftext|> é漢字 🦆🦆", "1234567 89", "a" * 300, " " * 777 + "b", "'re" * 50, "ab" * 500 + "\r\n" + "!?" * 40]


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 7)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)


def test_tree_equals_library(small_leaves):
    rng, e = random.Random(1), bpe.TreeEncoder(RANKS, P.PATTERN)
    alphabets = ["ab '", "aab", "  \n\tx", "'re 'll tve", "é 12ab  ", "hello worldtheing ", "   .,!x"]
    texts = TEXTS + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 200))) for a in alphabets for _ in range(60)]
    for t in texts:
        ids = e.encode(t)
        assert ids.tolist() == EXACT.encode_ordinary(t), t
        assert e.decode(ids) == t.encode()


def test_join_is_associative(small_leaves):
    e, raw = bpe.TreeEncoder(RANKS, P.PATTERN), b"internationalisation" * 9
    whole = e.merge(raw)
    for cut in range(1, len(raw), 7):
        assert e.join(e.merge(raw[:cut]), e.merge(raw[cut:])) == whole


def test_columns(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids int")
    ids = bpe.encode(F.col("text"), PATH, P.PATTERN)
    for r in df.select("text", ids.alias("got"), bpe.decode(ids, PATH, P.PATTERN).alias("back"), bpe.digests(ids, PATH, P.PATTERN).alias("d")).collect():
        assert r.got == EXACT.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
        assert r.d.n_tokens == len(r.got)
    assert df.where("false").select(ids.alias("x")).count() == 0


def test_unknown_ids_fail():
    with pytest.raises(KeyError):
        bpe.TreeEncoder(RANKS, P.PATTERN).decode(np.array([10**6]))


def test_hashes_that_meet(monkeypatch):
    """Pre-tokens of one hash are told apart by their characters."""
    monkeypatch.setattr(bpe, "AT_ONCE", 900)
    monkeypatch.setattr(bpe, "hash", lambda s: len(s) % 3, raising=False)
    rng, e = random.Random(5), bpe.TreeEncoder(RANKS, P.PATTERN)
    for _ in range(4):
        texts = ["", None, *(" ".join("".join(rng.choice("aé🦆xy1") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(30))]
        assert [ids.tolist() for ids in e.encode_all(texts)] == [EXACT.encode_ordinary(t or "") for t in texts]


def test_memory_of_a_pre_token():
    """pipeline: a worker's dictionary of pre-tokens took 137 bytes each, and executors more than their memory."""
    e = bpe.TreeEncoder(RANKS, P.PATTERN)
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{'qzj'[i % 3]}" for i in range(lo, lo + 500)) for lo in range(0, 17_500, 500)]
    tracemalloc.start()
    try:
        for t in texts:
            e.encode_all([t])
        e.leaves.clear()
        e.pairs.clear()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 80 * (len(e.ends) - 1)


def test_both_in_one_pass(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string")
    for r in df.select("text", bpe.encode_and_check(F.col("text"), PATH, P.PATTERN).alias("b")).collect():
        assert r.b.ids == EXACT.encode_ordinary(r.text or "") and r.b.n_tokens == len(r.b.ids)
        assert r.b.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_workers_forget_after_a_task(spark):
    """pipeline: workers of other stages still held the pre-tokens, leaves and pairs of all encoding tasks before."""
    df = spark.range(0, 400, 1, 8).select(F.concat_ws(" ", F.lit("it's"), F.col("id").cast("string"), F.lit("words")).alias("text"))
    assert df.select(bpe.encode_and_check(F.col("text"), PATH, P.PATTERN)["n_tokens"].alias("n")).agg(F.min("n")).first()[0] > 2

    def held(batches):
        for b in batches:
            e = bpe.encoder(PATH, P.PATTERN)
            b["n"] = len(e.ends) - 1 + len(e.leaves) + len(e.pairs)
            yield b[["n"]]

    assert spark.range(0, 32, 1, 32).mapInPandas(held, "n bigint").agg(F.max("n")).first()[0] == 0
