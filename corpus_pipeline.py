"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept:
quality classifier, toxicity, MinHash near duplicates, mixing to target weights, BPE.
All but the last return the columns of ``documents``; the last adds the token ids.

Defined results
- null and empty texts: kept or rejected by the classifiers' score for an empty text, alone in their
  near-duplicate group, without words for the mix, where they go;
- null doc_id: classified as any; no near duplicate of anything; placed in the mix by its text;
- repeated rows: of rows with one doc_id and text one stays behind the near duplicates;
- ties: by doc_id, then text; an empty table gives an empty result;
- extra columns pass through whatever their names, but for ``ids``, ``n_tokens`` and
  ``decoded_sha256``, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, mixing, neardup, quality, toxicity
from seqloom.sources.tables import materialize, table, unused


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    bpe.small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not call toxic."""
    bpe.small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    bpe.small_batches(spark)
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's cut is shortened."""
    return mixing.apply_mix(docs)


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digest of the bytes that these decode to."""
    import public_tokenizers

    bpe.small_batches(spark)
    both = bpe.encode_and_check(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    told = unused(docs, "told")
    return docs.withColumn(told, both).withColumns({c: F.col(told)[c] for c in ("ids", "n_tokens", "decoded_sha256")}).drop(told)


STAGES = [
    ("quality classifier", _quality),
    ("toxicity", _toxicity),
    ("near duplicates", _near_duplicates),
    ("mixing", _mixing),
    ("byte-level BPE", _encoding),
]

#: The stages learn models and run iterative joins, which SQL can't express; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
