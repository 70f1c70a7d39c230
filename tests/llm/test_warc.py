import gzip
import hashlib
import json

import pytest
from seqloom.llm import warc

PAGES = "page_id bigint, url string, html string, bucket int, keeper string"
ROWS = [(i, f"http://e.org/{i}?é=\n", f"<p>{i % 7}</p>é" * 50, 1, "k") for i in range(60)] + [(60, None, None, 1, "k"), (61, "u", "", 1, "k"), (None, "n", "<p>1</p>é" * 50, 1, "k"), (59, "again", "<p>3</p>é" * 50, 1, "k"), (62, "long", "x" * 300_000, 1, "k")]


def expected(rows, least=0):
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        to = top[h or ""] if len(raw) >= least and i != top[h or ""] else None
        out.append((i, len(raw), warc.base32_sha1(raw), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(ROWS, PAGES)
    warc.write_warc(df, str(tmp_path / "a"), roll_bytes=3000, min_revisit_bytes=least)
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(ROWS, least)
    by_id = {(i, u): h for i, u, h, *_ in ROWS}
    assert all(bytes(r.payload).decode() in by_id.values() or not r.payload for r in got if r.record_type == "response")


def test_same_files_from_any_partitioning(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES)
    one = warc.write_warc(df, str(tmp_path / "a"), roll_bytes=2000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    two = warc.write_warc(df.repartition(5), f"file://{tmp_path}/b", roll_bytes=2000)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == two and len(one) > 1
    assert json.loads((tmp_path / "a/MANIFEST.json").read_text()) == one
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(["MANIFEST.json", *(m["name"] for m in one)])
    for m in one:
        raw = (tmp_path / "a" / m["name"]).read_bytes()
        assert (len(raw), hashlib.sha1(raw).hexdigest()) == (m["bytes"], m["sha1"])
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == m["records"]


def test_damage_is_found():
    raw = warc.record(1, "u", b"payload", "s")
    assert warc.parse(raw)["body"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        list(warc.members([warc.member(raw)[:-5]]))


def test_reader_follows_the_manifest(spark, tmp_path):
    path = tmp_path / "m"
    manifest = warc.write_warc(spark.createDataFrame(ROWS, PAGES), str(path), roll_bytes=2000)
    with pytest.raises(FileExistsError):
        warc.write_warc(spark.createDataFrame(ROWS, PAGES), str(path))
    (path / "stray.warc.gz").write_bytes(warc.member(warc.record(9, "u", b"x", "s")))
    assert warc.read_warc(spark, str(path)).count() == len(ROWS)
    middle = path / manifest[1]["name"]
    raw = middle.read_bytes()
    for damaged in (raw + warc.member(warc.record(9, "u", b"x", "s")), b"", None):
        middle.unlink()
        if damaged is not None:
            middle.write_bytes(damaged)
        with pytest.raises(Exception, match="not the file|No such file|FileNotFound"):
            warc.read_warc(spark, str(path)).count()
    (path / "MANIFEST.json").unlink()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        warc.read_warc(spark, str(path)).count()


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (1, "u", "b"), (None, None, "a"), (None, None, "a"), (2, "w", "a")]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "u"))
    raw = b"".join((tmp_path / "u" / m["name"]).read_bytes() for m in manifest)
    found = [warc.parse(r) for r in warc.members([raw])]
    ids = [f["WARC-Record-ID"] for f in found]
    assert len(set(ids)) == len(rows)
    target = next(f["WARC-Record-ID"] for f in found if f.get("Page-ID") == "2")
    assert {f["WARC-Refers-To"] for f in found if f["WARC-Type"] == "revisit"} == {target}


def test_roll_size():
    assert warc.roll_size(0) == 16 << 20 and warc.roll_size(1 << 40) == 256 << 20 and warc.roll_size(10**14) == 1 << 30


def test_empty(spark, tmp_path):
    assert warc.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "e")) == []
    assert json.loads((tmp_path / "e/MANIFEST.json").read_text()) == []
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_large_ids_beside_null(spark, tmp_path):
    rows = [(None, "n", "<p>same</p>", 1, "k"), (2**53 + 1, "a", "<p>same</p>", 1, "k"), (2**53 + 3, "b", "<p>same</p>", 1, "k"), (2**53 + 5, "c", "other", 1, "k")]
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "a"))
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
