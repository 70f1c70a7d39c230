"""Texts of an Arrow column as code points: hashes of all substrings of a length, rotation order, character counts.

Helpers of the tasks' Arrow functions; they hold about ``SLICE`` characters, or one text, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(b: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, codes, starts) of a batch: the texts' code points one after another, and where each text's begin, with their end."""
    lengths = pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        before = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        rows = b.slice(lo, hi - lo)
        codes = np.frombuffer("".join(t or "" for t in rows.column(text).to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        yield rows, codes, np.concatenate(([0], ends[lo:hi] - before))
        lo = hi


def spelt(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def place_hashes(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the hash of so many characters from every place that has them.

    The hash of two strings joined is the first's times a power of a base, plus the second's, so hashes double.
    """
    join = lambda a, m, b, n: a[: max(0, len(codes) - m - n + 1)] * np.array([pow(int(_BASE), n, 1 << 64)], dtype=np.uint64) + b[m : m + max(0, len(codes) - m - n + 1)]
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    doubled = [x ^ (x >> np.uint64(31))]
    while 2 << (len(doubled) - 1) <= max(lengths):
        n = 1 << (len(doubled) - 1)
        doubled.append(join(doubled[-1], n, doubled[-1], n))
    found = {}
    for k in lengths:
        h, done = None, 0
        for j in range(k.bit_length()):
            if k >> j & 1:
                h, done = (doubled[j], 1 << j) if h is None else (join(h, done, doubled[j], 1 << j), done + (1 << j))
        found[k] = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return found


def hash_of(texts: pa.Array) -> pa.Array:
    """The hash of each whole text, as ``place_hashes`` has it; null for null and empty ones."""
    return pa.array([None if not t else place_hashes(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), [len(t)])[len(t)].astype(np.int64)[0] for t in texts.to_pylist()], pa.int64())


class Known:
    """A set of hashes; a table of bits tells of most others that they are not in it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))

    @cached_property
    def shift(self) -> np.uint64:
        return np.uint64(64 - min(24, max(16, (64 * len(self.hashes)).bit_length())))

    @cached_property
    def bits(self) -> np.ndarray:
        table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        table[(self.hashes >> self.shift).astype(np.int64)] = True
        return table

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """The ascending places of those of ``hashes`` that are in the set."""
        if not len(self.hashes):
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.bits[(hashes >> self.shift).astype(np.int64)])
        held = hashes[at]
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, held), len(self.hashes) - 1)] == held]


def rotation_order(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of all texts, text by text, by the order of the texts' rotations that begin there; equal rotations by place.

    Ranks by as many first characters as fit a number beside the text's, then doubled; only what shares its rank is sorted again.
    """
    n, total = np.diff(starts), len(codes)
    if not total:
        return np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    first, size, at = starts[row], n[row], np.arange(total)
    letters, code = np.unique(codes, return_inverse=True)
    width = max(1, int(len(letters) - 1).bit_length())
    h = max(1, (63 - len(n).bit_length()) // width)
    key, place = row.astype(np.int64), at.copy()
    for _ in range(h):
        key = key << width | code[place]
        place = np.where(place + 1 < first + size, place + 1, first)
    order = np.argsort(key, kind="stable")
    rank = np.empty(total, dtype=np.int64)

    def renew(order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Sets the ranks of sorted places from their keys and tells which of them still share one."""
        new = np.append(True, key[1:] != key[:-1])
        run = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[order] = base + run
        return ~(new & np.append(new[1:], True))

    tied = renew(order, key[order], np.zeros(total, dtype=np.int64))
    where = np.flatnonzero(tied)  # slots of the order that are not settled
    while True:
        where = where[size[order[where]] > h]
        if not len(where):
            return order
        held = order[where]
        key = rank[held] * np.int64(total) + rank[first[held] + (held - first[held] + h) % size[held]]
        by = np.argsort(key, kind="stable")  # what shares a rank is by place already
        held, key = held[by], key[by]
        order[where] = held
        where = where[renew(held, key, where - np.arange(len(where)))]
        h *= 2


def character_counts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n, before) of each text's different characters, ascending: how often they occur, and how many smaller ones there are."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key, n = np.unique(row << 21 | codes, return_counts=True)
    row = key >> 21
    return row, (key & ((1 << 21) - 1)).astype(np.uint32), n, np.cumsum(n) - n - starts[row]


def cut(codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings of ``length`` characters at ``begin``."""
    ends = np.cumsum(length)
    held = codes[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
    size = np.cumsum(np.concatenate(([0], 1 + (held > 0x7F) + (held > 0x7FF) + (held > 0xFFFF))))
    offsets = size[np.concatenate(([0], ends)).astype(np.int64)].astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets.tobytes()), pa.py_buffer(spelt(held).encode()))


def met(texts: pa.Array, known: dict[int, Known], reach: dict[int, int]) -> pa.Array:
    """Per text [(at, n, key, piece)]: its places at which the hash of n characters is known, for each n, with what stands there."""
    counts, parts = [], []
    for rows, codes, starts in slices(pa.record_batch({"t": texts}), "t"):
        hashes, found = place_hashes(codes, list(known)), []
        for n, among in known.items():
            at = among.among(hashes[n])
            row = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= starts[row + 1]
            at, row = at[inside], row[inside]
            piece = cut(codes, at, np.minimum(reach[n], starts[row + 1] - at))
            found.append((row, pa.StructArray.from_arrays([pa.array(at - starts[row], pa.int32()), pa.array(np.full(len(at), n), pa.int32()), pa.array(hashes[n][at].astype(np.int64)), piece], ["at", "n", "key", "piece"])))
        row = np.concatenate([r for r, _ in found])
        parts.append(pa.concat_arrays([p for _, p in found]).take(pa.array(np.argsort(row, kind="stable"))))
        counts.append(np.bincount(row, minlength=rows.num_rows))
    offsets = np.cumsum(np.concatenate([[0], *counts]))
    empty = pa.array([], pa.struct([("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("piece", pa.string())]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts) if parts else empty)


MET = "array<struct<at: int, n: int, key: bigint, piece: string>>"


def minimized(codes: np.ndarray, starts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, place, hash): runs of k-mers whose m-mer of least hash, the first of equals, stands at one place."""
    none = np.empty(0, dtype=np.int64)
    if len(codes) < k:
        return none, none, none, np.empty(0, dtype=np.uint64)
    h, total = place_hashes(codes, [m])[m], len(codes) - k + 1
    best, ahead = h[:total].copy(), np.zeros(total, dtype=np.int32)
    for i in range(1, k - m + 1):
        less = h[i : i + total] < best
        np.copyto(best, h[i : i + total], where=less)
        np.copyto(ahead, i, where=less)
    at = np.flatnonzero(np.arange(k, total + k) <= np.repeat(starts[1:], np.diff(starts))[:total])
    best, place = best[at], at + ahead[at]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else none
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] - at[first] + k, place[first], best[first]


def grouped(codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, n): the places of all k-mers, those of one text's equal k-mers together and ascending, and how many each group has."""
    at = np.arange(max(0, len(codes) - k + 1))
    row = np.searchsorted(starts, at, "right") - 1
    inside = at + k <= starts[row + 1]
    at, row = at[inside], row[inside]
    key, bits = row.astype(np.int64), len(starts).bit_length()
    for j in range(k):
        if bits + 21 > 63:  # whole numbers of the different beginnings so far
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bits = len(at).bit_length()
        key, bits = key << 21 | codes[at + j], bits + 21
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(at) else np.empty(0, dtype=np.int64)
    return row[order], at[order], np.diff(np.append(first, len(at)))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their lowest bytes, then all the next ones, and so on: small numbers leave zeros that pack to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def packed(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, gap: np.ndarray) -> tuple[bytes, int]:
    """(bytes, size): the pieces of text at ``begin`` with a number ``gap`` each, under zstd, and how many bytes they are without."""
    raw = _planes(gap) + _planes(length) + cut(codes, begin, length).buffers()[2].to_pybytes()
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True), len(raw)


def unpacked(held: bytes, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gap, begin, codes) of ``n`` packed pieces: their characters one after another, and where each begins, with their end."""
    raw = pa.Codec("zstd").decompress(held, size, asbytes=True)
    gap, length = (np.ascontiguousarray(x.T).view("<u4")[:, 0].astype(np.int64) for x in np.frombuffer(raw, dtype=np.uint8, count=8 * n).reshape(2, 4, n))
    return gap, np.append(0, np.cumsum(length)), np.frombuffer(raw[8 * n :].decode().encode("utf-32-le"), dtype=np.uint32)
