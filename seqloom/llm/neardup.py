"""MinHash near-duplicate detection.

1. Each document's set of word shingles gives ``bands * rows`` universal hash minima and
   one key per band. Equal word sequences, told by their SHA-256, form one class, of which
   the smallest doc_id stands for all; copies are never expanded into pairs.
2. Stars: in each band bucket of several classes the smallest id is the centre, and
   the members whose signatures agree with the centre's are confirmed on full sets. Large-star and small-star turn the links into components.
3. Rest: the buckets of one centre may still hold a link that the centre is not part of.
   Where a centre's members lie in different components, those outside its largest
   component are compared with all members of other components, block against block with
   their texts. A pair of blocks is a task's unit of work, dealt by the hash of all three of
   (centre, left block, right block), so that no centre decides the longest task, and only
   confirmed links leave a task. Components are then found again.
After step 3 every two classes that share a bucket are in one component or were compared.

A pair of similarity s shares no bucket with probability (1 - s^rows)^bands: 1.3e-7 at
0.8 for the default 40 x 5, and the signature screen loses about 3e-7 of such pairs. Links are
confirmed on the shingles themselves; n_shingles counts 64-bit hashes and is one too small
with probability n^2 / 2^65.

Defined results
- null, empty or wordless texts: the empty set, linked with nothing;
- rows that share a doc_id are one document, linked if any of their texts is; its
  n_shingles is the largest;
- null doc_id: a document that nothing can be linked with; ``near_duplicates`` has no row for
  it and ``drop_near_duplicates`` keeps it;
- empty table: empty result; other columns are ignored whatever their names, and
  ``drop_near_duplicates`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, unused

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
BITS = 1 << 24  # of the filter that is broadcast to find candidates' texts
BLOCK = 30_000  # shingles of the texts in a block of the third step
SALTS = 64
SHARE = 1_000


def words_of(text: str | None) -> list[str]:
    """Words of the text with A-Z lower-cased."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    """Distinct k-word shingles; the whole sequence if there are fewer words; empty without words."""
    w = words_of(text)
    if not w:
        return set()
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = _U(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            base = 0x9E3779B97F4A7C55
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in a text's bytes, A-Z as a-z, by polynomial sums."""
    inside = ~_SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(raw))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + _U(1)) * up, dtype=np.uint64)))
    return start, end, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted."""
    _, _, word = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if not len(word):
        return np.empty(0, dtype=np.uint64)
    m = min(k, len(word))
    n = len(word) - m + 1
    shingle = np.zeros(n, dtype=np.uint64)
    for i in range(m):
        shingle = _mix(shingle + word[i : i + n] + _STEP)
    if len(word) < k:
        shingle = _mix(shingle + _U(len(word)))
    return np.unique(shingle)


def sequence_key(text: str) -> bytes:
    """SHA-256 of the text's words, A-Z as a-z, with one blank behind each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    blank = _SEPARATOR[raw]
    kept = ~blank | (blank & np.concatenate(([False], ~blank[:-1])))
    return hashlib.sha256(np.where(blank, 0x20, _FOLD[raw])[kept].astype(np.uint8).tobytes()).digest()


class MinHasher:
    """``bands * rows`` minima of (a x + b) mod 2^64 >> 32, with random odd a and random b."""

    def __init__(self, k: int, bands: int, rows: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        top = np.iinfo(np.uint64).max
        self.k, self.bands, self.rows = k, bands, rows
        self.a = (rng.integers(0, top, bands * rows, dtype=np.uint64) | _U(1))[:, None]
        self.b = rng.integers(0, top, bands * rows, dtype=np.uint64)[:, None]
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)

    def minima(self, x: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, len(x), 128):  # a block stays in the core's cache
            np.minimum(least, (self.a * x[lo : lo + 128] + self.b).min(axis=1), out=least)
        return (least >> _U(32)).astype(np.uint32)

    def document(self, text: str | None) -> tuple[int, bytes, bytes, np.ndarray]:
        """Set size, key of the word sequence, a byte per minimum, a key per band."""
        x = shingle_hashes(text, self.k)
        if not len(x):
            return 0, b"", b"", np.empty(0, dtype=np.int64)
        least = self.minima(x)
        band = self.salt.copy()
        for column in least.reshape(self.bands, self.rows).T:
            band = _mix(band + column.astype(np.uint64) + _STEP)
        sketch = (_mix(least.astype(np.uint64)) & _U(255)).astype(np.uint8)
        return len(x), sequence_key(text), sketch.tobytes(), band.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n, text_key, sketch, band_keys) per row; one narrow pass over the texts."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHasher(k, bands, rows, seed)
        for b in batches:
            got = [hasher.document(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [g[0] for g in got], "text_key": [g[1] for g in got], "sketch": [g[2] for g in got], "band_keys": [g[3] for g in got]})

    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows_in.mapInPandas(sign, "doc_id bigint, n bigint, text_key binary, sketch binary, band_keys array<bigint>")


def _agreeing(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Equal bytes of two columns of sketches."""
    if not len(a):
        return np.empty(0, dtype=np.int64)
    x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), -1)
    return (x == y).sum(axis=1)


def _least_agreement(hashes: int, percent: int) -> int:
    """Equal minima that a pair at the threshold reaches but for 5 standard deviations."""
    s = percent / 100
    return max(0, int(hashes * s - 5 * (hashes * s * (1 - s)) ** 0.5))


def marked_by_bits(docs: DataFrame, ids: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``docs`` with a boolean ``name``: false only where doc_id is surely not among ``ids`` (doc_id).

    One hash bit per id, in ``bits`` / 64 words at most, which is the bound of what is broadcast. With
    more ids more documents are marked in vain, and only cost their shuffle.
    """
    p, w, b = (unused(docs, c) for c in ("p", "w", "b"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(bits))
    words = ids.select(place.alias(p)).groupBy(F.floor(F.col(p) / 64).alias(w)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({p} % 64 as int))")).alias(b))
    hit = docs.join(F.broadcast(words), F.floor(place / 64) == F.col(w), "left")
    bit = F.col(b).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")))
    return hit.withColumn(name, F.coalesce(bit != 0, F.lit(False))).drop(w, b)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents among ``ids``; other texts are mostly left out before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return marked_by_bits(rows, ids, "_m").where("_m").drop("_m").join(ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity: 100 * both >= percent * either.

    Texts join twice by equi-joins, that of a centre's members by a salt too: a centre of
    a large group meets its members in several tasks.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = texts_of(docs, wanted)
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, set] = ("", set())
        for b in batches:
            keep = []
            for x, y in zip(b["text_u"], b["text_v"], strict=True):
                if x != last[0]:  # pairs of one centre come together
                    last = (x, shingle_set(x, k))
                one, two = last[1], shingle_set(y, k)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both) and both > 0)
            yield b.loc[keep, ["u", "v"]]

    # a centre's text goes to as many of SALTS tasks as its members fall into
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(left, "u")
    full = salted.join(right, "v").join(left, ["u", "salt"]).select("u", "v", "text_u", "text_v")
    return full.mapInPandas(check, "u bigint, v bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): nodes of the links with the smallest node reachable, by large-star and small-star.

    Each round is a map-side combined minimum per node and an equi-join back, written to the
    shared folder. Ends when a round changes nothing; then all edges point to roots.
    """

    def least(edges: DataFrame, by: str, of: str) -> DataFrame:
        return edges.groupBy(F.col(by).alias("_k")).agg(F.min(of).alias("_m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both, "u", "v").select("_k", F.least("_k", "_m").alias("_m"))
        return both.join(m, both["u"] == m["_k"]).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = least(down, "u", "v")
        joined = down.join(m, down["u"] == m["_k"]).select("u", "v", "_m")
        return joined.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).union(m.select(F.col("_k").alias("u"), F.col("_m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("bigint")).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return tuple(r)

    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        new = materialize(small(large(edges)), "edges")
        after = mark(new)
        discard(edges)
        edges = new
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _links_of_groups(groups: DataFrame, docs: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Links (u, v) of different components inside groups (z, rep, root, main, total, outside, n, sketch).

    Members outside the main component, in blocks, meet all members of their group, in blocks. A member
    goes to every pair of blocks that its own is part of.
    """
    spark = docs.sparkSession
    wanted = groups.select(F.col("rep").alias("doc_id")).distinct()
    texts = texts_of(docs, wanted).withColumnRenamed("doc_id", "rep")
    blocks = lambda size: F.ceil(F.col(size) / BLOCK).cast("int")
    slot = lambda size: F.pmod(F.xxhash64("rep"), blocks(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), blocks(size) - 1))
    own = ["z", "rep", "root", "n", "sketch"]
    left = groups.where("root <> main").select(*own, F.lit(True).alias("first"), slot("outside").alias("i"), every("total").alias("j"))
    right = groups.select(*own, F.lit(False).alias("first"), slot("total").alias("j"), every("outside").alias("i"))
    held = left.unionByName(right).join(texts, "rep")
    member = F.struct("rep", "root", "n", "sketch", "text")
    tiles = held.groupBy("z", "i", "j").agg(F.collect_list(F.when(F.col("first"), member)).alias("left"), F.collect_list(F.when(~F.col("first"), member)).alias("right")).select("left", "right")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def columns(block) -> tuple:
            ids, roots, sizes = (np.array([m[c] for m in block], dtype=np.int64) for c in ("rep", "root", "n"))
            return ids, roots, sizes, np.frombuffer(b"".join(bytes(m["sketch"]) for m in block), dtype=np.uint8).reshape(len(ids), -1)

        for b in batches:
            us, vs = [], []
            for left, right in zip(b["left"], b["right"], strict=True):
                if not len(left) or not len(right):
                    continue
                (xi, xr, xn, xs), (yi, yr, yn, ys) = columns(left), columns(right)
                sets: dict[int, set] = {}
                for i in range(len(xi)):
                    near = ((ys == xs[i]).sum(axis=1) >= least) & (yr != xr[i]) & (100 * np.minimum(yn, xn[i]) >= percent * np.maximum(yn, xn[i]))
                    found = np.flatnonzero(near)
                    if len(found):
                        one = shingle_set(left[i]["text"], k)
                        for j in found:
                            two = sets.get(j)
                            if two is None:
                                two = sets[j] = shingle_set(right[j]["text"], k)
                            both = len(one & two)
                            if both and 100 * both >= percent * (len(one) + len(two) - both):
                                us.append(min(xi[i], yi[j]))
                                vs.append(max(xi[i], yi[j]))
            yield pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row holds two blocks of texts
    try:
        return materialize(tiles.mapInPandas(compare, "u bigint, v bigint").distinct(), "links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _roots_of_rows(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n, root) of the rows ``signed`` by their class in ``roots`` (text_key, n, root, copies).

    Classes with over a 1 / SHARE of all rows, fewer than SHARE, are broadcast, so that the copies of a common text are
    looked up where they are; a row without shingles is its own root.
    """
    all_rows = roots.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") * SHARE > all_rows
    rows = signed.select("doc_id", "n", "text_key")
    known = rows.where("n > 0").join(F.broadcast(roots.where(common).select("text_key", "n", "root")), ["text_key", "n"], "left")
    others = known.where("root is null").drop("root").join(roots.where(~common).select("text_key", "n", "root"), ["text_key", "n"])
    parts = [known.where("root is not null"), others, rows.where("n = 0").withColumn("root", F.col("doc_id"))]
    return reduce(DataFrame.unionByName, [p.select("doc_id", "n", "root") for p in parts])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for the documents ``docs`` (doc_id, text)."""
    least = _least_agreement(bands * rows, percent)
    likely = bands * rows * (percent - 4) // 100  # stars below it are left to the third step
    signed = materialize(signatures(docs, k, bands, rows, seed), "signatures")
    # one class per set; the smallest id stands for it, and equal sets have equal signatures
    classes = materialize(signed.where("n > 0").groupBy("text_key", "n").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("band_keys").alias("band_keys"), F.count("*").alias("copies")), "classes")
    buckets = classes.select(F.explode("band_keys").alias("bucket"), "rep")
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("_top")).where("centre <> _top").select("bucket", "centre")
    members = materialize(buckets.join(shared, "bucket").select("centre", "rep").distinct(), "members")
    light = classes.select("rep", "n", "sketch")

    stars = members.where("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v"))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[_agreeing(b["su"], b["sv"]) >= likely, ["u", "v"]]

    side = lambda name: light.select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    # a centre's sketch goes to as many of SALTS tasks as its members fall into
    salted = stars.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    centres = salted.select("u", "salt").distinct().join(side("u"), "u")
    screened = (
        salted.join(side("v"), "v").join(centres, ["u", "salt"])
        .where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
        .select("u", "v", "su", "sv").mapInPandas(screen, "u bigint, v bigint").distinct()
    )
    screened = materialize(screened, "screened")
    links = materialize(confirm(screened, docs, k, percent), "links")
    first = components(links)

    groups = members.select(F.col("centre").alias("z"), "rep").union(members.select("centre", "centre")).distinct()
    rooted = groups.join(first, groups["rep"] == first["node"], "left").select("z", "rep", F.coalesce("root", "rep").alias("root")).join(light, "rep")
    sizes = rooted.groupBy("z", "root").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    mixed = sizes.groupBy("z").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("total").alias("total"), F.max(F.struct("c", "root", "total"))["total"].alias("inside"), F.count("*").alias("roots")).where("roots > 1")
    mixed = mixed.select("z", "main", "total", (F.col("total") - F.col("inside")).alias("outside"))
    # a centre's members meet its facts in SALTS tasks
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")
    facts = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = materialize(rooted.select("*", salt).join(facts, ["z", "salt"]).drop("salt"), "groups")
    more = _links_of_groups(held, docs, k, percent, least)
    final = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    roots = classes.select("text_key", "n", "rep", "copies").join(final, F.col("rep") == final["node"], "left")
    roots = materialize(roots.select("text_key", "n", F.coalesce("root", "rep").alias("root"), "copies"), "roots")
    for done in (classes, members, screened, links, held, more):
        discard(done)
    out = _roots_of_rows(signed, roots)
    # a document whose rows have several texts joins all their classes
    ids = out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("root").alias("component_id"), F.max("root").alias("_other"))
    ids = materialize(ids, "components")
    torn = ids.where("component_id <> _other").select(F.col("component_id").alias("u"), F.col("_other").alias("v"))
    if not torn.isEmpty():
        joined = components(out.join(ids.where("component_id <> _other").select("doc_id", "component_id"), "doc_id").select(F.col("root").alias("u"), F.col("component_id").alias("v")))
        ids = ids.join(joined, ids["component_id"] == joined["node"], "left").withColumn("component_id", F.coalesce("root", "component_id"))
    return ids.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and all without a doc_id.

    Repeats of one row under one doc_id are copies too: of rows that share a kept doc_id
    one stays, that with the smallest text.
    """
    found = materialize(near_duplicates(docs, **options).select(F.col("doc_id"), "kept"), "kept")
    m, lost_id, nth = (unused(docs, c) for c in ("m", "lost", "nth"))
    # documents that surely lost to none stay where they are; the others are looked up
    marked = marked_by_bits(docs, found.where("not kept"), m)
    lost = found.where("not kept").select(F.col("doc_id").alias(lost_id))
    sure = ~F.col(m) | F.col("doc_id").isNull()
    held = marked.where(sure).unionByName(marked.where(~sure).join(lost, F.col("doc_id").cast("bigint") == F.col(lost_id), "left_anti")).drop(m)
    repeats = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(nth)).where(F.col(nth) > 1).limit(1)
    if repeats.isEmpty():
        return held
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    return held.withColumn(nth, F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.row_number().over(order))).where(F.col(nth) == 1).drop(nth)
