"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoded stretches are values that join associatively, so a text is encoded by halves.

- Pre-tokens: halves of a text are matched against the pattern on their own. Joining takes
  the left half's last matches (``look`` characters at least: how far past a match the
  pattern can depend on the text, 3 for patterns with contractions like "'re") and as many of
  the right half's first ones, and matches that window again, with the window growing until
  one of its new boundaries is a boundary of the right half. From a common boundary on,
  matching depends on the text that follows only, so all matches outside the window stand.
- Merges inside a pre-token: halves of its bytes are encoded, and the tokens at the seam
  are encoded again in a window that grows until its first and last tokens stand beside
  their outer neighbours. Two neighbours stand if encoding their joint bytes gives those
  two tokens. If all neighbours stand, no merge crosses any token boundary in the whole,
  for the first that did would do so in the two tokens' bytes alone; so the sequence is
  what greedy merging gives.

Leaves are at most ``LEAF_CHARS`` characters of a text and ``LEAF_BYTES`` bytes of a pre-token.
What a worker has found for leaves, pairs of tokens and pre-tokens is remembered, up to a bound,
for speed alone; ``encode_and_check`` drops it when its task ends. Decoding concatenates the tokens'
bytes up the same tree.

Defined results
- null text: as the empty text, no tokens, empty bytes;
- unpaired surrogates cannot occur in Spark strings; invalid ids raise KeyError;
- empty table: empty result; other columns, also of clashing names, pass through unread.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LEAF_CHARS = 256  # characters of a text that are matched in one go
LEAF_BYTES = 4  # bytes of a pre-token that are merged in one go
LOOK = 3
MEMO = 1_000_000  # pre-tokens remembered by a worker
PARTS = 250_000  # leaves, and as many pairs of tokens
AT_ONCE = 1 << 19  # characters of texts, or one text, whose pre-tokens are held at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, look: int = LOOK) -> None:
        self.ranks, self.look = ranks, look
        self.token = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Keep the vocabulary alone."""
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[int, list[int] | None] = {}  # None: the two stand
        self._forget()

    def _forget(self) -> None:
        """The pre-token of number p has the ids ``self.ids[self.ends[p] : self.ends[p + 1]]``.

        Pre-tokens are found by their hashes, which ascend, and compared with the characters kept of them: under
        80 bytes a pre-token, where a dictionary of strings took 137.
        """
        self.hashes, self.number = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        self.ends, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32)
        self.said, self.stops = np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)  # the pre-tokens' bytes, as the ids

    # merges

    def merge(self, raw: bytes) -> list[int]:
        """Greedy merging, lowest rank first, leftmost among equals."""
        n, ranks = len(raw), self.ranks
        if n == 1:
            return [ranks[raw]]
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def leaf(self, raw: bytes) -> list[int]:
        got = self.leaves.get(raw)
        if got is None:
            if len(self.leaves) >= PARTS:
                self.leaves.clear()
            got = self.leaves[raw] = self.merge(raw)
        return got

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' joint bytes; they stand if it is they."""
        key = a << 32 | b
        got = self.pairs.get(key, False)
        if got is False:
            if len(self.pairs) >= PARTS:
                self.pairs.clear()
            got = self.merge(self.token[a] + self.token[b])
            got = self.pairs[key] = None if got == [a, b] else got
        return [a, b] if got is None else got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joint bytes of two encoded stretches."""
        if not left or not right:
            return left or right
        w, middle = 1, self.pair(left[-1], right[0])
        while True:
            fits_left = w >= len(left) or self.pair(left[-w - 1], middle[0]) == [left[-w - 1], middle[0]]
            fits_right = w >= len(right) or self.pair(middle[-1], right[w]) == [middle[-1], right[w]]
            if fits_left and fits_right:
                return left[:-w] + middle + right[w:]
            w *= 2
            middle = self.merge(b"".join(map(self.token.__getitem__, left[-w:] + right[:w])))

    def stretch(self, raw: bytes) -> list[int]:
        """The encoding of a pre-token's bytes by halves."""
        if len(raw) <= LEAF_BYTES:
            return self.leaf(raw) if raw else []
        half = len(raw) // 2
        return self.join(self.stretch(raw[:half]), self.stretch(raw[half:]))

    def _known(self, pieces: pa.StringArray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of pre-tokens, -1 for those not seen before."""
        if not len(self.hashes):
            return np.full(len(pieces), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        number = self.number[at[found]].astype(np.int64)
        length = self.stops[number + 1] - self.stops[number]
        stop = np.cumsum(length)
        raw = self.said[np.repeat(self.stops[number] - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)]
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(np.append(0, stop).astype(np.int64)), pa.py_buffer(raw)])
        same = pc.equal(held, pieces.take(pa.array(found)).cast(pa.large_binary())).to_numpy(zero_copy_only=False)
        known = np.full(len(pieces), -1, dtype=np.int64)
        known[found[same]] = number[same]
        return known

    def _numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """The numbers of different pre-tokens; those not seen before are encoded."""
        if len(self.ends) - 1 + len(pieces) > MEMO:
            self._forget()
        strings = pieces.to_pylist()
        hashes = np.fromiter(map(hash, strings), dtype=np.int64, count=len(strings))
        known = self._known(pieces, hashes)
        new = np.flatnonzero(known < 0)
        if len(new):
            first = len(self.ends) - 1
            known[new] = np.arange(first, first + len(new))
            raw = [strings[i].encode("utf-8") for i in new.tolist()]
            got = [self.stretch(r) for r in raw]
            self.ids = np.concatenate((self.ids, np.array([i for g in got for i in g], dtype=np.int32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(g) for g in got], dtype=np.int64)))
            self.said = np.concatenate((self.said, np.frombuffer(b"".join(raw), dtype=np.uint8)))
            self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum([len(r) for r in raw], dtype=np.int64)))
            order = np.argsort(hashes[new], kind="stable")
            place = np.searchsorted(self.hashes, hashes[new][order])
            self.hashes = np.insert(self.hashes, place, hashes[new][order])
            self.number = np.insert(self.number, place, known[new][order].astype(np.int32))
        return known

    # pre-tokens

    def seam(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of the joint text of two matched stretches."""
        if not left or not right:
            return left or right
        keep, length = len(left), 0
        while keep and length < self.look:
            keep -= 1
            length += len(left[keep])
        tail, take = "".join(left[keep:]), 1
        while True:
            window = tail + "".join(right[:take])
            matched = self.find(window)
            if take >= len(right):
                return left[:keep] + matched
            edges, at = {}, len(tail)
            for i in range(take + 1):
                edges[at] = i
                at += len(right[i])
            at = 0
            for j, m in enumerate(matched):
                if at in edges and at + self.look <= len(window):
                    return left[:keep] + matched[:j] + right[edges[at] :]
                at += len(m)
            take *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self.seam(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, ``AT_ONCE`` characters of them at a time."""
        got, ends, lo = [], np.cumsum([len(t or "") for t in texts]), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            got += self._encode_some(texts[lo:hi])
            lo = hi
        return got

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text: different pre-tokens are encoded, and all gather their ids at once."""
        pieces = [self.pieces(t) if t else [] for t in texts]
        each = pa.array([p for ps in pieces for p in ps], type=pa.string()).dictionary_encode()
        number = self._numbers(each.dictionary)[each.indices.to_numpy()]
        length = self.ends[number + 1] - self.ends[number]
        stop = np.cumsum(length)
        ids = self.ids[np.repeat(self.ends[number] - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)]
        upto = np.concatenate(([0], stop))[np.cumsum([0, *map(len, pieces)])]
        return [ids[lo:hi] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Token bytes, concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> TreeEncoder:
    """One per worker and vocabulary."""
    return TreeEncoder(read_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of ids; the vocabulary's file must be at ``path`` on every executor."""

    @F.pandas_udf("array<int>")
    def to_ids(texts: pd.Series) -> pd.Series:
        e = encoder(path, pattern)
        return pd.Series(e.encode_all(list(texts)), dtype=object)

    return to_ids(text.cast("string"))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary of the ids' bytes; null gives null."""

    @F.pandas_udf("binary")
    def to_bytes(rows: pd.Series) -> pd.Series:
        e = encoder(path, pattern)
        return pd.Series([None if r is None else e.decode(np.asarray(r)) for r in rows], dtype=object)

    return to_bytes(ids)


def encode_and_check(text: Column, path: str, pattern: str) -> Column:
    """struct(ids, n_tokens, decoded_sha256) in one pass: the ids, and the digest of the bytes that they decode to."""

    @F.pandas_udf("ids array<int>, n_tokens bigint, decoded_sha256 string")
    def to_both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path, pattern)
        try:
            for texts in batches:
                each = e.encode_all(list(texts))
                yield pd.DataFrame({"ids": pd.Series(each, dtype=object), "n_tokens": pd.Series(list(map(len, each)), dtype="int64"), "decoded_sha256": pd.Series([hashlib.sha256(e.decode(r)).hexdigest() for r in each], dtype=object)})
        finally:
            e.forget()  # the worker stays for other tasks, also of other stages
            pa.default_memory_pool().release_unused()

    return to_both(text.cast("string"))


def digests(ids: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of encoded ids."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def to_digests(rows: pd.Series) -> pd.DataFrame:
        e = encoder(path, pattern)
        each = [np.asarray(r, dtype=np.int32) for r in rows]
        counts = [len(r) for r in each]
        told = pa.array(np.concatenate(each) if each else np.empty(0, dtype=np.int32)).cast(pa.string())
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), type=pa.int32()), told), " ")
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        return pd.DataFrame({"n_tokens": counts, "ids_sha256": [sha(t.as_buffer()) for t in told], "decoded_sha256": [sha(e.decode(r)) for r in each]})

    return to_digests(ids)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows per Arrow batch, for columns of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
