"""The queries of the operators, each over its whole table with production parameters.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE_SQL`` has DuckDB SQL for
those that SQL can express. The operators live in the sibling modules; here are only their
inputs, parameters and digest columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import batch_session, scratch_path, table
from . import bpe, chat, clustering, fingerprint, flac, merkle, mixing, neardup, quality, tokenfiles, toxicity, urlfilter, warc


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and its edited text, and their likeness by peeling."""
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    return chat.conversation_digests(chat.format_windows(turns.unionByName(extra)))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    spark = batch_session(spark, 512)
    docs = table(spark, sf_dir, "documents")
    got = bpe.digests(bpe.encode(F.col("text"), path, pattern), path, pattern)
    return docs.select("doc_id", got.alias("d")).select("doc_id", "d.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by a mix at weights 5, 2, 1."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, from labels outside fold 1 of 3."""
    spark = batch_session(spark, 512)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream of 8-bit samples, stored, read back and decoded, with features of the samples."""
    spark = batch_session(spark, 1024)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    padded = F.greatest(F.ceil(size / 64) * 64, F.lit(64)).cast("int")
    payload = F.concat(raw, F.unhex(F.repeat(F.lit("00"), padded - size)))
    docs = table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("n_bytes")).alias("key"), payload.alias("payload"))
    encoded = flac.encode_column(docs, "key", "payload").select("key.doc_id", "key.n_bytes", "media")
    media = flac.store_media(encoded, scratch_path(spark, "media"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored = b.column("media").to_pylist()
            rows = []
            for m, blocks in zip(stored, flac.decode_streams(stored), strict=True):
                back = flac.payload_of(blocks)
                x = np.frombuffer(back, dtype=np.uint8).astype(np.int64) - 128
                crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
                feature = f"frames={len(blocks)} sum={int(x.sum())} energy={int((x * x).sum())} peak={int(np.abs(x).max())} crossings={crossings}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            told = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *told], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(describe, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    path = scratch_path(spark, "warc")
    spark = batch_session(spark, 512)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids in Parquet files ordered by doc_id, read back from them."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    spark = batch_session(spark, 512)
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, from labels outside fold 0 of 5."""
    spark = batch_session(spark, 512)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are similar by 0.8 or more."""
    spark = batch_session(spark, 512)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest of all, where a seventh of them are presented with another n_chars."""
    spark = batch_session(spark)
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    return merkle.verified(merkle.proofs(merkle.build(docs, changed=changed)))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by four rules."""
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster of eight after ten rounds."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chat": op2_chat,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_flac": op6_flac,
    "op7_warc": op7_warc,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_neardup": op10_neardup,
    "op11_merkle": op11_merkle,
    "op12_url_filter": op12_url_filter,
    "op13_clustering": op13_clustering,
}



def _rounds_sql(rounds: int = 10) -> str:
    """Lloyd's rounds as a chain of tables: centroids c0, c1, ..., and each vector's nearest, a0, a1, ..."""
    near = "SELECT i, v, vec_id, c.cluster, list_sum(list_transform(list_zip(v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM vectors, c{0} c QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c.cluster) = 1"
    moved = """SELECT c.cluster, coalesce(m2, m) AS m FROM c{0} c LEFT JOIN (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m2 FROM (
    SELECT cluster, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS j FROM a{0}) GROUP BY cluster, j) GROUP BY cluster) USING (cluster)"""
    steps = "".join(f", a{r} AS MATERIALIZED ({near.format(r)}), c{r + 1} AS MATERIALIZED ({moved.format(r)})" for r in range(rounds))
    return f"""WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, v AS m FROM vectors QUALIFY cluster < 8
){steps}, last AS MATERIALIZED ({near.format(rounds)})
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN c{rounds} USING (cluster)"""


#: Hash orders, learnt scores, sketches and token ids are beyond SQL; tests/llm hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    # the windows of chat.py at a budget of 512 tokens, 128 of history, two earlier turns
    "op2_chat": r"""
WITH said AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), counted AS (
  SELECT *, (11 + len(regexp_extract_all(role, '\w+|[^\w\s]')) + len(regexp_extract_all(text, '\w+|[^\w\s]')))::BIGINT AS cost,
    22 + 2 * length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')) + length(role) - length(replace(role, '"', '')) AS chars
  FROM said
), numbered AS (
  SELECT *, row_number() OVER o AS n, sum(cost) OVER (o ROWS UNBOUNDED PRECEDING) AS ends FROM counted WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), placed AS (
  SELECT *, max(CASE WHEN n = 1 AND role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM numbered
), lengths AS (
  SELECT *, greatest(1, 512 - 128 - system) AS stretch FROM placed
), spans AS (
  SELECT *, CASE WHEN (ends - 1) // stretch > (ends - cost) // stretch THEN 2 * ((ends - 1) // stretch) - 1 ELSE 2 * ((ends - cost) // stretch) END AS span,
    CASE WHEN (ends - 1) // stretch > (ends - cost) // stretch THEN greatest(0, least(128, 512 - system - cost)) ELSE 128 END AS history FROM lengths
), firsts AS (
  SELECT *, span IS DISTINCT FROM lag(span) OVER (PARTITION BY conv_id ORDER BY n) AS new FROM spans
), again AS (
  SELECT a.conv_id, a.chars FROM firsts a JOIN firsts b ON b.conv_id = a.conv_id AND b.n IN (a.n + 1, a.n + 2) AND b.new AND (b.ends - b.cost) - (a.ends - a.cost) <= b.history
  WHERE NOT (a.n = 1 AND a.role = 'system')
  UNION ALL
  SELECT a.conv_id, a.chars FROM firsts a JOIN firsts b ON b.conv_id = a.conv_id AND b.new AND b.n > 1 AND b.span <> a.span WHERE a.n = 1 AND a.role = 'system'
)
SELECT f.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(any_value(r.more), 0))::BIGINT AS formatted_chars
FROM firsts f LEFT JOIN (SELECT conv_id, sum(chars) AS more FROM again GROUP BY conv_id) r ON r.conv_id = f.conv_id
GROUP BY f.conv_id""",
    "op7_warc": """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM m""",
    # nodes of a level as a list per group, folded in halves; levels of the groups, then of the subroots
    "op11_merkle": """
WITH RECURSIVE fields AS (
  SELECT doc_id::BIGINT AS doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    n_chars::HUGEINT AS n, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents
), leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS lang, sha256(a || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || z) AS leaf, sha256(a || coalesce(strlen((n + 1)::VARCHAR) || ':' || (n + 1), '-') || z) AS changed FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, level AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM trees WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM crown WHERE len(nodes) > 1
), nodes AS (
  SELECT lang, level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS at FROM trees WHERE len(nodes) > 1
  UNION ALL
  SELECT lang, top + level, unnest(nodes), unnest(range(len(nodes))) FROM subroots, crown WHERE len(nodes) > 1
), bytes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), checked AS (
  SELECT p.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 7 = 0 AS tampered FROM placed p, bytes
), walk AS (
  SELECT doc_id, lang, i, leaf, 0 AS level, CASE WHEN top = 0 THEN g ELSE i END AS at, top, g, (SELECT max(level) FROM crown) + top AS height, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS h
  FROM checked JOIN subroots USING (lang)
  UNION ALL
  SELECT w.doc_id, w.lang, w.i, w.leaf, w.level + 1, CASE WHEN w.level + 1 = top THEN g ELSE w.at // 2 END, top, g, height, proof || coalesce(digest, ''),
    CASE WHEN w.at % 2 = 1 THEN sha256(digest || h) ELSE sha256(h || coalesce(digest, '')) END
  FROM walk w LEFT JOIN nodes n ON n.lang = w.lang AND n.level = w.level AND n.at = xor(w.at, 1) WHERE w.level < height
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = nodes[1] AS verified
FROM walk w JOIN subroots USING (lang) JOIN crown c ON len(c.nodes) = 1 WHERE w.level = height""",
    "op12_url_filter": """
WITH parts AS (
  SELECT page_id::BIGINT AS page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM parts""",
    "op13_clustering": _rounds_sql(),
}
