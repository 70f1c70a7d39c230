"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by (page_id, url, payload digest) and compressed one gzip member
each, with headers and digests made anew. A payload is shuffled to its range once; which record
it refers to comes as a row per range and repeated payload. A global prefix sum of the compressed
sizes gives each record its file, so where files roll depends on the records and ``roll_bytes``
alone, not on the number of partitions. Each file is written by one task under a temporary name
and renamed by it once whole; its bytes depend on the records alone, so a repeated task renames
the same file again. The driver commits last, by renaming a manifest of a row per file: a reader
takes the manifest's files and no others, and checks their lengths and digests.

Of records with equal payloads the one with the largest page_id is a ``response``, the
others are ``revisit`` records that refer to it and carry no payload, only its length in
the HTTP header and its digest. Groups are found on digests with map-side combined
maxima, so a payload that a third of all pages share costs no large group.

``path`` is qualified by Hadoop's default file system, as Spark does it, and opened by pyarrow.

Defined results
- null html: an empty payload; null url: no target URI; null page_id: sorted first, never
  the record that others refer to;
- rows that repeat the largest page_id of a payload are all responses; every row's record has an
  id of its own, also where page_id, url and payload repeat;
- rows of one page_id are compressed by one task;
- empty table: no files, an empty manifest, an empty result; other columns are ignored;
- a target that holds anything: FileExistsError; a missing manifest or file, or one of other
  bytes than the manifest says: an error on reading.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, partitions, quantile_bounds, range_bucket

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the UUID namespace of URLs


def record_id(page_id: int | None, url: str | None, sha: str, nth: int = 0) -> str:
    """The id of the ``nth`` record of one page_id, url and payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([page_id, url, sha, nth]))}>"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, nth: int = 0, refers_to: tuple[int, str | None] | None = None) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit if ``refers_to`` (page_id, url) is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, sha, nth)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|")))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers_to, sha)), ("Refers-To-Page-ID", str(refers_to[0])), ("WARC-Truncated", "length")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a file that comes in pieces."""
    d, parts = None, []
    for piece in pieces:
        while piece:
            d = d or zlib.decompressobj(31)
            parts.append(d.decompress(piece))
            piece = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts = None, []
    if d is not None:
        raise ValueError("a gzip member is cut short")


def parse(raw: bytes) -> dict:
    """Fields, HTTP head and body of a record; block and payload digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    fields["body"] = body
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(body)}":
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    return fields


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with its scheme, by the session's Hadoop settings."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the place in it of a URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def roll_size(total: int) -> int:
    """Bytes of a file for so many in all: a power of two from 16 MiB to 1 GiB, 4,096 files up to 4 TiB."""
    return min(max(16 << 20, 1 << (max(1, total // 4096) - 1).bit_length()), 1 << 30)


def write_warc(pages: DataFrame, path: str, roll_bytes: int | None = None, min_revisit_bytes: int = 0, level: int = 6) -> list[dict]:
    """Write ``pages`` (page_id, url, html) below ``path`` and return the manifest's rows.

    ``roll_bytes``: the size at which files roll; None for ``roll_size`` of all records' bytes.
    The manifest has a row per file, which is all that comes to the driver.
    """
    spark = pages.sparkSession
    base = _qualified(spark, path)
    fs, root = _filesystem(base)
    if fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{base} is not empty")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    n = partitions(spark)
    bucket = range_bucket(F.col("page_id"), quantile_bounds(rows, F.col("page_id"), n)).cast("int")
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bucket", bucket)
    shared = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("bucket", "sha", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")).alias("k"))
    keepers = shared.groupBy("sha").agg(F.max("k").alias("keeper"), F.count("*").alias("_n")).where("_n > 1 and keeper is not null")
    told = shared.select("bucket", "sha").distinct().join(keepers, "sha")
    none = F.lit(None)
    # a range's keepers come before its records
    first = told.select("bucket", F.lit(0).alias("kind"), F.col("keeper.page_id").alias("page_id"), F.col("keeper.url").alias("url"), "sha", none.cast("binary").alias("payload"))
    dealt = first.unionByName(rows.withColumn("kind", F.lit(1))).repartitionById(n, F.col("bucket")).sortWithinPartitions("kind", "page_id", "url", "sha")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keeper, last, nth = 0, {}, None, 0
        for b in batches:
            packed, buckets = [], []
            for k, kind, i, u, sha, p in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "page_id", "url", "sha", "payload")), strict=True):
                if kind == 0:
                    keeper[sha] = (i, u)
                    continue
                nth = nth + 1 if last == (i, u, sha) else 0
                last, to = (i, u, sha), keeper.get(sha)
                packed.append(member(record(i, u, p, sha, nth, to if to and to[0] != i else None), level))
                buckets.append(k)
            sizes = np.array([len(x) for x in packed], dtype=np.int64)
            ends = at + np.cumsum(sizes)
            if len(ends):
                at = int(ends[-1])
            columns = [pa.array(buckets, pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "local_start", "size", "member"])

    held = dealt.select("bucket", "kind", "page_id", "url", "sha", "payload")
    packed = materialize(held.mapInArrow(compress, "bucket int, local_start bigint, size bigint, member binary"), "warc-members")
    totals = packed.groupBy("bucket").agg(F.sum("size").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per range
    total = bases.agg(F.sum("n")).first()[0] or 0
    roll = roll_bytes or roll_size(total)
    start = F.col("base") + F.col("local_start")
    placed = packed.join(F.broadcast(bases.drop("n")), "bucket").select(F.floor(start / roll).cast("int").alias("file"), start.alias("start"), "member")
    fs.create_dir(f"{root}/_temporary", recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, folder = _filesystem(base)
        now, out = None, None

        def close() -> Iterator[pd.DataFrame]:
            if out is not None:
                out.close()
                name = f"records-{now['file']:06d}.warc.gz"
                where.move(now["temporary"], f"{folder}/{name}")
                yield pd.DataFrame({"name": [name], "records": [now["n"]], "bytes": [now["size"]], "sha1": [now["sha1"].hexdigest()]})

        for b in batches:
            for f, m in zip(b["file"], b["member"], strict=True):
                if now is None or now["file"] != f:
                    yield from close()
                    now = {"file": int(f), "temporary": f"{folder}/_temporary/{uuid.uuid4().hex}", "n": 0, "size": 0, "sha1": hashlib.sha1()}
                    out = where.open_output_stream(now["temporary"], compression=None)
                out.write(bytes(m))
                now["sha1"].update(m)
                now["n"], now["size"] = now["n"] + 1, now["size"] + len(m)
        yield from close()

    done = placed.repartitionById(total // roll + 1, F.col("file")).sortWithinPartitions("start").mapInPandas(write, "name string, records bigint, bytes bigint, sha1 string").collect()
    manifest = sorted((r.asDict() for r in done), key=lambda r: r["name"])
    with fs.open_output_stream(f"{root}/_temporary/manifest", compression=None) as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{root}/_temporary/manifest", f"{root}/MANIFEST.json")
    fs.delete_dir(f"{root}/_temporary")
    discard(packed)
    return manifest


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the manifest's records below ``path``."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    base = _qualified(spark, path)
    manifest = spark.read.schema("name string, records bigint, bytes bigint, sha1 string").option("mode", "FAILFAST").json(f"{base}/MANIFEST.json", multiLine=True)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _filesystem(base)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        whole = lambda v: None if v is None else int(v)

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for name, n, size, sha1 in zip(*(b.column(c).to_pylist() for c in ("name", "records", "bytes", "sha1")), strict=True):
                told, seen, rows, found = hashlib.sha1(), 0, [], 0

                def pieces() -> Iterator[bytes]:
                    nonlocal seen
                    with where.open_input_stream(f"{folder}/{name}", compression=None) as f:  # noqa: B023
                        while piece := f.read(1 << 20):
                            seen += len(piece)
                            told.update(piece)  # noqa: B023
                            yield piece

                for raw in members(pieces()):
                    f, found = parse(raw), found + 1
                    kind = f["WARC-Type"]
                    rows.append((whole(f.get("Page-ID")), f.get("WARC-Target-URI"), int(f["http"]["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), kind, whole(f.get("Refers-To-Page-ID")), f["body"] if kind == "response" else None))
                    if len(rows) >= 256:
                        yield frame(rows)
                        rows = []
                if (found, seen, told.hexdigest()) != (n, size, sha1):
                    raise ValueError(f"{name} is not the file of the manifest")
                yield frame(rows)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(records, schema)
