"""FLAC media columns: encode 8-bit mono samples, decode Rice residuals and linear predictors.

The decoder reads any number of streams at once. Residuals and predictors are sequential
within a frame but not between frames, so all frames of a batch advance in step, one sample
of every frame at a time: numpy works across frames, and a stream of any length is a set of
frames. Header (CRC-8) and frame (CRC-16) checksums and the stream's MD5 are verified. The
result is PCM blocks with the number of their first sample, so that a reader can seek;
``write_pcm_blocks`` stores them as rows and ``read_samples`` reads a range of samples.

The encoder picks per frame the cheapest of constant, verbatim, fixed predictors of order
0 to 2 and a quantised linear predictor, with Rice partitions, and writes a seek table with
every frame.

Supported: mono streams of 8 bits per sample of fixed block size (what the encoder writes,
and any other encoder's such streams with a seek table of all frames or none at all).

Defined results
- null payload: as the empty one; an empty payload is a stream without frames;
- corrupt input (magic, checksums, lengths, MD5) raises ValueError;
- empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096
RATE = 8000
LPC_ORDER, LPC_BITS = 6, 10
GROUP = 1024  # frames that advance in step

_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}  # fixed values: FLAC's fixed predictors


def _crc_step(poly: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << width) - 1)
    return table.astype(np.uint16)


_CRC8, _CRC16 = _crc_step(0x07, 8), _crc_step(0x8005, 16)  # fixed values: FLAC's polynomials


def crc8(raw: bytes) -> int:
    c = 0
    for x in raw:
        c = int(_CRC8[c ^ x])
    return c


class _Crc16:
    """Row d of the table: what a byte adds to the checksum when d bytes follow it."""

    def __init__(self) -> None:
        self.table = _CRC16[None, :]

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksums of raw[starts:ends], ascending slices without gaps."""
        longest = int((ends - starts).max())
        while len(self.table) < longest:
            rows = [self.table[-1]]
            for _ in range(max(longest - len(self.table), 1024)):
                t = rows[-1]
                rows.append(((t & 255) << 8) ^ _CRC16[t >> 8])
            self.table = np.concatenate((self.table, np.array(rows[1:], dtype=np.uint16)))
        after = np.repeat(ends, ends - starts) - np.arange(starts[0], ends[-1]) - 1
        return np.bitwise_xor.reduceat(self.table[after, raw[starts[0] : ends[-1]]], starts - starts[0])


_crc16 = _Crc16()


def _coded_number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            break
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _read_coded_number(raw: bytes, at: int) -> tuple[int, int]:
    first = raw[at]
    if first < 0x80:
        return first, at + 1
    more = 0
    while first << more & 0x80:
        more += 1
    n = first & (0x7F >> more)
    for x in raw[at + 1 : at + more]:
        n = n << 6 | x & 0x3F
    return n, at + more


# encoder


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of the rows of x by Levinson's recursion, and their shift."""
    f = x.astype(np.float32)
    size = f.shape[1]
    auto = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : size - k]) for k in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    a = np.zeros((len(x), LPC_ORDER))
    err = auto[:, 0] * 1.0001 + 1
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], auto[:, i:0:-1])) / err
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, err = new, np.maximum(err * (1 - k * k), 1)
    top = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.maximum(top, 2.0**-8) + 1e-9)), 0, 15).astype(np.int64)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.round(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x less its prediction, for all columns (the first ``order`` ones are not used)."""
    order = coef.shape[1]
    total = np.zeros(x.shape, dtype=np.int32)
    for j in range(order):
        total[:, order:] += coef[:, j, None].astype(np.int32) * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return x - (total >> shift[:, None].astype(np.int32))


def _partition_order(n: int, order: int) -> int:
    p = 0
    while p < 6 and n % (2 << p) == 0 and n >> (p + 1) >= max(64, order + 1):
        p += 1
    return p


class _Bits:
    """A bit array that numpy fills at many positions at once."""

    def __init__(self, n: int) -> None:
        self.bits = np.zeros(n, dtype=np.uint8)

    def put(self, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            self.bits[at + j] = values >> (width - 1 - j) & 1


def _encode_group(rows: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames of the given blocks of samples."""
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), max(int(lengths.max()), LPC_ORDER + 1)), dtype=np.int32)
    for r, to in zip(rows, x, strict=True):
        to[: len(r)] = r
    inside = np.arange(x.shape[1]) < lengths[:, None]
    coef, shift = _predictors(x)
    options = []  # (order, residuals): fixed 0, 1, 2 and linear
    options.append((0, x))
    options.append((1, np.diff(x, axis=1, prepend=0)))
    options.append((2, np.diff(options[1][1], axis=1, prepend=0)))
    options.append((LPC_ORDER, _residuals(x, coef, shift)))
    cost = np.stack([np.log2(np.where(inside, np.abs(r), 0).sum(axis=1) / lengths * 2 + 1) * lengths + 8 * o for o, r in options], axis=1)
    cost[:, 3] += LPC_ORDER * LPC_BITS + 9
    cost[lengths <= LPC_ORDER, 3] = np.inf
    cost[lengths <= 2, 1:3] = np.inf
    best = cost.argmin(axis=1)
    constant = np.array([len(r) > 0 and bool((r == r[0]).all()) for r in rows])
    orders = np.array([0, 1, 2, LPC_ORDER])[best]
    res = np.choose(best[:, None], [o[1] for o in options])
    zig = np.where(res >= 0, 2 * res, -2 * res - 1)
    parts = np.array([_partition_order(int(n), int(o)) for n, o in zip(lengths, orders, strict=True)])
    size = lengths >> parts  # samples of a partition
    column = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    coded = inside & (column >= orders[:, None])
    part_of = np.minimum(column // size[:, None], (1 << parts)[:, None] - 1)
    flat = np.flatnonzero(coded)
    which = (np.broadcast_to(np.arange(len(rows))[:, None], x.shape).ravel()[flat].astype(np.int64) << 7) + part_of.ravel()[flat]
    u = zig.ravel()[flat].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(flat) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(flat)))
    sums = np.add.reduceat(u, first) if len(flat) else np.empty(0)
    k_part = np.clip(np.floor(np.log2(np.maximum(sums / np.maximum(counts, 1), 1e-9) * 0.7 + 1e-9) + 0.5), 0, 14).astype(np.int64)
    k = np.repeat(k_part, counts)
    bits = (u >> k) + 1 + k
    row_of_part = which[first] >> 7 if len(flat) else np.empty(0, dtype=np.int64)
    rice = np.zeros(len(rows), dtype=np.int64)
    np.add.at(rice, row_of_part, np.add.reduceat(bits, first) if len(flat) else 0)
    lpc = best == 3
    body = 8 + orders * 8 + np.where(lpc, 9 + LPC_ORDER * LPC_BITS, 0) + 6 + (4 << parts) + rice
    verbatim = ~constant & (body >= 8 + 8 * lengths)
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * lengths, body))
    heads = []
    for n, number in zip(lengths, numbers, strict=True):
        # sync and fixed blocks; 16-bit block size and 8 kHz; mono of 8 bits
        h = b"\xff\xf8\x74\x02" + _coded_number(number) + int(n - 1).to_bytes(2, "big")
        heads.append(h + bytes([crc8(h)]))
    head = np.array([len(h) for h in heads])
    total = head + (body + 7) // 8
    ends = np.cumsum(total)
    starts = ends - total
    out = _Bits(int(ends[-1]) * 8)
    at = (starts + head) * 8  # where subframes begin
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 0x20 | (LPC_ORDER - 1), 8 | orders)))
    out.put(at, kind << 1, 8)
    at = at + 8
    for i in np.flatnonzero(constant | verbatim):
        values = rows[i][:1] if constant[i] else rows[i]
        out.put(at[i] + 8 * np.arange(len(values)), values.astype(np.int64) & 255, 8)
    coded_row = ~(constant | verbatim)
    for j in range(LPC_ORDER):
        has = coded_row & (orders > j)
        out.put(at[has] + 8 * j, x[has, j].astype(np.int64) & 255, 8)
    at = at + 8 * orders
    has = coded_row & lpc
    out.put(at[has], np.full(int(has.sum()), LPC_BITS - 1), 4)
    out.put(at[has] + 4, shift[has], 5)
    for j in range(LPC_ORDER):
        out.put(at[has] + 9 + j * LPC_BITS, coef[has, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    at = at + np.where(lpc, 9 + LPC_ORDER * LPC_BITS, 0)
    out.put(at[coded_row], parts[coded_row], 6)  # method 0 in two bits, then the partition order
    at = at + 6
    if len(flat):
        use = coded_row[row_of_part]
        spread = np.repeat(use, counts)
        lead = bits.copy()
        lead[first] += 4  # the parameter goes before a partition's first residual
        run = np.cumsum(lead) - lead
        row_first = np.flatnonzero(np.concatenate(([True], row_of_part[1:] != row_of_part[:-1])))
        base = np.repeat(run[first[row_first]], np.diff(np.append(row_first, len(first))))
        where = np.repeat(at[row_of_part] - base, counts) + run
        out.put(where[first][use], k_part[use], 4)
        where[first] += 4
        where, u, k = where[spread], u[spread], k[spread]
        stop = where + (u >> k)
        out.bits[stop] = 1
        for j in range(int(k.max()) if len(k) else 0):
            sel = k > j
            out.bits[stop[sel] + k[sel] - j] = u[sel] >> j & 1
    return _close(heads, np.packbits(out.bits), starts, ends)


def _close(heads: list[bytes], out: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Put the headers in front and the checksums behind."""
    for i in range(max(map(len, heads))):
        has = np.array([len(h) > i for h in heads])
        out[starts[has] + i] = [h[i] for h in heads if len(h) > i]
    crc = _crc16.of(out, starts, ends)
    packed = out.tobytes()
    return [packed[s:e] + int(c).to_bytes(2, "big") for s, e, c in zip(starts, ends, crc, strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream per payload; a byte b is the sample b - 128."""
    blocks, numbers, owner = [], [], []
    for i, p in enumerate(payloads):
        samples = np.frombuffer(p, dtype=np.uint8).astype(np.int32) - 128
        for n, lo in enumerate(range(0, len(samples), BLOCK)):
            blocks.append(samples[lo : lo + BLOCK])
            numbers.append(n)
            owner.append(i)
    frames: list[list[bytes]] = [[] for _ in payloads]
    order = sorted(range(len(blocks)), key=lambda i: len(blocks[i]))  # rows of a group have like lengths
    done: list[bytes] = [b""] * len(blocks)
    for lo in range(0, len(order), GROUP // 4):
        part = order[lo : lo + GROUP // 4]
        for i, f in zip(part, _encode_group([blocks[i] for i in part], [numbers[i] for i in part]), strict=True):
            done[i] = f
    for i, f in zip(owner, done, strict=True):
        frames[i].append(f)
    out = []
    for p, fs in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in fs]
        pcm = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points, offset = [], 0
        for n, s in enumerate(sizes):
            points.append((n * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(p) - n * BLOCK).to_bytes(2, "big"))
            offset += s
        seek = b"".join(points)
        metadata = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        out.append(b"fLaC" + metadata + b"".join(fs))
    return out


# decoder


def _frames_of(stream: bytes) -> tuple[list[tuple[int, int, int]], int, bytes]:
    """(first sample, start, end) of a stream's frames, the number of samples and the MD5."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, seek, info = 4, False, b"", b""
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        info, seek = (body if kind == 0 else info), (body if kind == 3 else seek)
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    total, block = packed & (1 << 36) - 1, int.from_bytes(info[:2], "big")
    if packed >> 36 & 31 != 7 or packed >> 41 & 7 != 0:
        raise ValueError("only mono streams of 8 bits are supported")
    count = -(-total // block) if total else 0
    points = [(int.from_bytes(seek[i : i + 8], "big"), at + int.from_bytes(seek[i + 8 : i + 16], "big")) for i in range(0, len(seek) - 17, 18)]
    if [p[0] for p in points] != [i * block for i in range(count)]:
        points, pos = [], at  # without a full seek table: headers in sequence, told by CRC-8 and number
        while len(points) < count and (pos := stream.find(b"\xff\xf8", pos)) >= 0:
            number, end = _read_coded_number(stream, pos + 4)
            end += {6: 1, 7: 2}.get(stream[pos + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(stream[pos + 2] & 15, 0)
            if number == len(points) and end < len(stream) and crc8(stream[pos:end]) == stream[end]:
                points.append((number * block, pos))
            pos += 1
    if len(points) != count:
        raise ValueError("frames are missing")
    ends = [p[1] for p in points[1:]] + [len(stream)] * bool(points)
    return [(p[0], p[1], e) for p, e in zip(points, ends, strict=True)], total, info[18:34]


_LEADING = np.array([16 - int(v).bit_length() for v in range(1 << 16)], dtype=np.int64)
_U = np.uint64


def _decode_group(frames: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Samples of frames (bytes, expected number of samples)."""
    sizes = np.array([len(f) for f, _ in frames])
    raw = np.frombuffer(b"".join(f for f, _ in frames) + bytes(16), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # the checksum of a frame with its own checksum behind it is 0
    if (_crc16.of(raw, starts, ends) != 0).any():
        raise ValueError("frame checksum differs")
    lengths = np.array([n for _, n in frames])
    at = np.empty(len(frames), dtype=np.int64)
    for i, (f, n) in enumerate(frames):
        if f[:2] != b"\xff\xf8":
            raise ValueError("no frame where one should be")
        _, end = _read_coded_number(f, 4)
        code = f[2] >> 4
        size = {1: 192, 6: f[end] + 1, 7: int.from_bytes(f[end : end + 2], "big") + 1}.get(code, 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0)
        end += {6: 1, 7: 2}.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(f[2] & 15, 0)
        if crc8(f[:end]) != f[end]:
            raise ValueError("header checksum differs")
        if size != n:
            raise ValueError("block size differs")
        at[i] = (starts[i] + end + 1) * 8
    window = np.zeros(len(raw) - 7, dtype=np.uint64)
    for j in range(8):
        window |= raw[j : len(raw) - 7 + j].astype(np.uint64) << _U(56 - 8 * j)

    def peek(where: np.ndarray) -> np.ndarray:
        """57 bits or more from each position, at the top of 64."""
        return window[where >> 3] << (where & 7).astype(np.uint64)

    def take(where: np.ndarray, width: int) -> np.ndarray:
        return (peek(where) >> _U(64 - width)).astype(np.int64)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    kind = take(at, 8) >> 1
    at += 8
    samples: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(frames)
    for i in np.flatnonzero(kind <= 1):
        if kind[i] == 0:
            samples[i] = np.full(lengths[i], signed(take(at[i : i + 1], 8), 8)[0])
        else:
            samples[i] = signed(take(at[i] + 8 * np.arange(lengths[i]), 8), 8)
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("reserved subframe type")
    # coded frames, longest first, so that those that still go on are the first ones
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return samples
    coded = coded[np.argsort(-lengths[coded], kind="stable")]
    at, kind, lengths = at[coded], kind[coded], lengths[coded]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    most = int(order.max())
    n, longest = len(coded), int(lengths[0])
    out = np.zeros((most + longest, n), dtype=np.int64)  # row most + i holds sample i
    coef, shift = np.zeros((max(most, 1), n), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for j in range(most):
        has = np.flatnonzero(order > j)
        out[most + j, has] = signed(take(at[has] + 8 * j, 8), 8)
    at = at + 8 * order
    lpc = np.flatnonzero(kind >= 32)
    precision = take(at[lpc], 4) + 1
    shift[lpc] = take(at[lpc] + 4, 5)
    at[lpc] += 9
    for j in range(most):
        has = order[lpc] > j
        for width in np.unique(precision[has]):
            sel = lpc[has & (precision == width)]
            coef[j, sel] = signed(take(at[sel], int(width)), int(width))
        at[lpc[has]] += precision[has]
    for o, values in _FIXED.items():
        sel = np.flatnonzero((kind < 32) & (order == o))
        for j, v in enumerate(values if len(sel) else ()):
            coef[j, sel] = v
    method = take(at, 2)
    if (method > 1).any():
        raise ValueError("reserved residual coding method")
    wide = np.where(method == 1, 5, 4)
    parts = take(at + 2, 4)
    at = at + 6
    size = lengths >> parts
    # residuals, a sample of every frame at a time
    k, escape = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    following = order.copy()  # the sample at which the next parameter is read
    marks = set(np.unique(order).tolist())
    for s in np.unique(size):
        marks.update(range(int(s), longest, int(s)))
    going = np.searchsorted(-lengths, -np.arange(longest), side="left")  # frames longer than i
    early = int(order.max())
    raws = False
    for i in range(int(order.min()), longest):
        m = int(going[i])
        if i in marks:
            sel = np.flatnonzero(following[:m] == i)
            if len(sel):
                w = wide[sel]
                p = np.where(w == 5, take(at[sel], 5), take(at[sel], 4))
                at[sel] += w
                esc = p == (1 << w) - 1
                if esc.any():
                    p[esc] = take(at[sel[esc]], 5)
                    at[sel[esc]] += 5
                k[sel], escape[sel] = p, esc
                raws = bool(escape.any())
                following[sel] = (i // size[sel] + 1) * size[sel]
        x, kk = peek(at[:m]), k[:m]
        q = _LEADING[(x >> _U(48)).astype(np.int64)]
        if q.max(initial=0) == 16:  # long runs of zeros
            more = np.flatnonzero(q == 16)
            if raws:
                more = more[~escape[more]]
            while len(more):
                step = _LEADING[take(at[more] + q[more], 16)]
                q[more] += step
                more = more[step == 16]
        if q.max(initial=0) + kk.max(initial=0) > 54:
            rest = (peek(at[:m] + q + 1) >> _U(1)) >> (63 - kk).astype(np.uint64)
        else:
            rest = ((x << (q + 1).astype(np.uint64)) >> _U(1)) >> (63 - kk).astype(np.uint64)
        u = (q << kk) | rest.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        used = q + 1 + kk
        if raws and escape[:m].any():
            e = np.flatnonzero(escape[:m])
            v = np.where(kk[e] > 0, ((x[e] >> _U(1)) >> (63 - kk[e]).astype(np.uint64)).astype(np.int64), 0)
            r[e] = np.where(kk[e] > 0, v - ((v >> np.maximum(kk[e] - 1, 0) & 1) << kk[e]), 0)
            used[e] = kk[e]
        if i < early:
            go = order[:m] <= i
            used, r = np.where(go, used, 0), np.where(go, r, 0)
        row = most + i
        if most:
            guess = np.einsum("ij,ij->j", coef[:most, :m], out[row - 1 : row - most - 1 if row > most else None : -1, :m]) >> shift[:m]
            if i < early:
                guess = np.where(go, guess, 0)
            out[row, :m] += r + guess
        else:
            out[row, :m] = r
        at[:m] += used
    for j, i in enumerate(coded):
        samples[i] = out[most : most + lengths[j], j]
    return samples


def decode_streams(streams: list[bytes], verify: bool = True) -> list[list[tuple[int, int, bytes]]]:
    """Per stream its PCM blocks (first sample, samples, signed 8-bit PCM); every checksum is verified."""
    jobs, told = [], []
    for i, s in enumerate(streams):
        frames, total, md5 = _frames_of(s)
        told.append((total, md5))
        for n, (first, lo, hi) in enumerate(frames):
            length = (frames[n + 1][0] if n + 1 < len(frames) else total) - first
            jobs.append((i, first, s[lo:hi], length))
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]
    order = sorted(range(len(jobs)), key=lambda j: -jobs[j][3])
    got: list[bytes] = [b""] * len(jobs)
    for lo in range(0, len(order), GROUP):
        part = order[lo : lo + GROUP]
        for j, samples in zip(part, _decode_group([(jobs[j][2], jobs[j][3]) for j in part]), strict=True):
            got[j] = samples.astype(np.int8).tobytes()
    for (i, first, _, length), pcm in zip(jobs, got, strict=True):
        out[i].append((first, length, pcm))
    for blocks, (total, md5) in zip(out, told, strict=True):
        if sum(b[1] for b in blocks) != total:
            raise ValueError("samples are missing")
        if verify and hashlib.md5(b"".join(b[2] for b in blocks)).digest() != md5:
            raise ValueError("stream checksum differs")
    return out


def payload_of(blocks: list[tuple[int, int, bytes]]) -> bytes:
    """The bytes that PCM blocks stand for."""
    return (np.frombuffer(b"".join(b[2] for b in blocks), dtype=np.uint8) ^ 0x80).tobytes()


# Spark


def encode_column(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, media): the binary column ``payload`` as FLAC; a narrow pass."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = encode_streams([p or b"" for p in b.column("payload").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(media, pa.binary())], ["key", "media"])

    return df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInArrow(run, f"key {kind}, media binary").withColumnRenamed("key", key)


def store_media(media: DataFrame, path: str) -> DataFrame:
    """Write a table with streams as Parquet and return it as read back from there.

    zstd finds what streams have in common, such as those of copies that lie near each other.
    """
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


def decode_blocks(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per PCM block: (key, first_sample, n_samples, pcm); a narrow pass."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, blocks in enumerate(decode_streams(b.column("media").to_pylist())) for x in blocks]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("key").take(columns[0]), *columns[1:]], ["key", "first_sample", "n_samples", "pcm"])

    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {kind}, first_sample bigint, n_samples int, pcm binary").withColumnRenamed("key", key)


def write_pcm_blocks(blocks: DataFrame, path: str, key: str) -> None:
    """PCM blocks as Parquet, ordered by key and sample in each file, so that statistics find a range."""
    blocks.sortWithinPartitions(key, "first_sample").write.parquet(path)


def read_samples(spark: SparkSession, path: str, key: str, value: object, start: int, count: int) -> DataFrame:
    """Blocks that hold samples start to start + count - 1 of one stream, cut to them: (first_sample, pcm)."""
    held = spark.read.parquet(path).where((F.col(key) == F.lit(value)) & (F.col("first_sample") < start + count) & (F.col("first_sample") + F.col("n_samples") > start))
    skip = F.greatest(F.lit(0).cast("bigint"), F.lit(start) - F.col("first_sample"))
    stop = F.least(F.col("n_samples").cast("bigint"), F.lit(start + count) - F.col("first_sample"))
    return held.select((F.col("first_sample") + skip).alias("first_sample"), F.substring("pcm", (skip + 1).cast("int"), (stop - skip).cast("int")).alias("pcm"))
