"""The registered queries of the operators that SQL does not express, on the smallest tables, by plain rules."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from seqloom.llm import bpe, neardup
from seqloom.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, SF).collect()}
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        t, m = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - m] + texts[ids[(n + 1) % len(ids)]][:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_op3(spark, texts):
    exact = tiktoken.Encoding("exact", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op3_byte_bpe"](spark, SF).collect():
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op4(spark, texts):
    rows = QUERIES["op4_mixing"](spark, SF).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(neardup.words_of(t)) for i, t in texts.items()}
    for s in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == s]
        assert sum(r["size"] for r in own) == s and sum(r.taken for r in own) == round(own[0].target)


@pytest.mark.parametrize("name,label,folds,held", [("op5_quality", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_op5_op9(spark, texts, name, label, folds, held):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op6(spark, texts):
    for r in QUERIES["op6_flac"](spark, SF).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        x = np.frombuffer(padded, dtype=np.uint8).astype(int) - 128
        assert f"sum={x.sum()} energy={(x * x).sum()} peak={np.abs(x).max()}" in r.feature


def test_op8(spark, texts):
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, SF).collect()}
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(spark, texts):
    sets = {i: neardup.shingle_set(t, 2) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_neardup"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
