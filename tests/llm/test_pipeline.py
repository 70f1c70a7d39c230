import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from seqloom.llm import bpe, mixing, neardup, quality, toxicity
from seqloom.sources.tables import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def test_columns(stages):
    docs, *outs = stages
    assert all(o.columns == docs.columns for o in outs[:-1])
    assert outs[-1].columns == [*docs.columns, "ids", "n_tokens", "decoded_sha256"]


def test_filters_follow_their_models(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for before, after, module, keep in ((stages[0], stages[1], quality, "_s >= 0.5"), (stages[1], stages[2], toxicity, "_s < 0.5")):
        want = module.score(before, module.fit(before, labels), "_s").where(keep)
        assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in want.select("doc_id").collect()}
        assert after.count() > 0.5 * before.count()


def test_one_of_each_near_group_stays(stages):
    sets = {r.doc_id: neardup.shingle_set(r.text, 5) for r in stages[2].collect()}
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
    assert sorted(r.doc_id for r in stages[3].collect()) == [i for i in ids if find(i) == i]


def test_mix_and_tokens(stages):
    want = mixing.mix(stages[3]).agg(F.sum("taken")).first()[0]
    assert stages[4].agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    import public_tokenizers as P

    e = bpe.TreeEncoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for r in stages[5].collect():
        assert e.decode(__import__("numpy").array(r.ids)) == r.text.encode() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_clashing_columns_and_nulls(spark, stages):
    """Columns of the stages' own names come through, and so does a row without a doc_id."""
    extra = ["_score", "_m", "_p", "_w", "_b", "_nth", "_lost", "_size", "_mixed", "_mixed_source", "key", "tie", "before", "_told"]
    docs = stages[0].withColumns({c: F.lit(c) for c in extra})
    docs = docs.unionByName(docs.orderBy("doc_id").limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    for _, f in corpus_pipeline.STAGES[1:]:
        docs = materialize(f(spark, docs, SF), "clash")
    rows = docs.collect()
    assert rows and all(r[c] == c for r in rows for c in extra) and any(r.doc_id is None for r in rows)


def test_run_equals_stages(spark, stages):
    key = lambda d: sorted((r.doc_id, r.n_tokens) for r in d.select("doc_id", "n_tokens").collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_empty(spark, stages):
    docs = stages[0].where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


def test_texts_are_encoded_once(spark, stages):
    """pipeline: the digest's function had its own encoding of the text beside that of the ids."""
    plan = corpus_pipeline.STAGES[-1][1](spark, stages[0], SF)._jdf.queryExecution().executedPlan().toString()
    assert "to_ids" not in plan and plan.count("ArrowEvalPython") == 1
