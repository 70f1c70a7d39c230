"""Cell recurrences of alignment in numpy: a row of cells of many pairs at a time.

Within a row, a gap in seq1 is a running maximum: row[j] = max over k <= j of
(u[k] - k * gap) + j * gap, where u has what comes from the row above.
"""

from __future__ import annotations

import numpy as np

CELLS = 1 << 22  # cells of a traced pair that are held at once
LEAST = -(1 << 40)


def _codes(seqs: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the sequences, padded to the longest, and their lengths."""
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    out = np.full((len(seqs), int(lengths.max(initial=0))), pad, dtype=np.int64)
    for row, s in zip(out, seqs, strict=True):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out, lengths


def _batches(one: list[str], two: list[str], cells: int = 1 << 21):
    """Indices of pairs of like lengths, whose rows together have a bounded size."""
    order = sorted(range(len(one)), key=lambda i: (len(two[i]), len(one[i])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 4096 and (hi + 1 - lo) * (len(two[order[hi]]) + 1) <= cells // 8 and len(two[order[hi]]) <= 2 * len(two[order[lo]]) + 16:
            hi += 1
        yield np.array(order[lo:hi])
        lo = hi


def _linear(one: list[str], two: list[str], match: int, mismatch: int, gap: int, floor: bool) -> np.ndarray:
    """Global scores (the last cell), or local ones (the best cell, floored at 0)."""
    out = np.zeros(len(one), dtype=np.int64)
    for part in _batches(one, two):
        a, m = _codes([one[i] for i in part], -1)
        b, n = _codes([two[i] for i in part], -2)
        slope = np.arange(b.shape[1] + 1, dtype=np.int64) * gap
        row = np.zeros((len(part), b.shape[1] + 1), dtype=np.int64) if floor else np.broadcast_to(slope, (len(part), len(slope))).copy()
        inside = np.arange(b.shape[1] + 1) <= n[:, None]
        best = np.zeros(len(part), dtype=np.int64) if floor else np.take_along_axis(row, n[:, None], 1)[:, 0]
        for i in range(a.shape[1]):
            u = row + gap
            np.maximum(u[:, 1:], row[:, :-1] + np.where(b == a[:, i, None], match, mismatch), out=u[:, 1:])
            if floor:
                np.maximum(u, 0, out=u)
            row = np.maximum.accumulate(u - slope, axis=1) + slope
            live = i < m
            if floor:
                best = np.where(live, np.maximum(best, np.where(inside, row, 0).max(axis=1)), best)
            else:
                best = np.where(live, np.take_along_axis(row, n[:, None], 1)[:, 0], best)
        out[part] = best
    return out


def global_scores(one: list[str], two: list[str], match: int, mismatch: int, gap: int) -> np.ndarray:
    return _linear(one, two, match, mismatch, gap, False)


def local_scores(one: list[str], two: list[str], match: int, mismatch: int, gap: int) -> np.ndarray:
    return _linear(one, two, match, mismatch, gap, True)


def _affine_row(M: np.ndarray, I: np.ndarray, D: np.ndarray, same: np.ndarray, opened: int, extend: int, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next row of the three states; ``same`` holds the pair scores, ``opened`` a gap's first step."""
    d = np.maximum(np.maximum(M, I) + opened, D + extend)
    np.maximum(d, 0, out=d)
    m = np.maximum(np.maximum(M[..., :-1], I[..., :-1]), D[..., :-1]) + same
    m = np.concatenate((np.zeros_like(M[..., :1]), np.maximum(m, 0)), axis=-1)
    d[..., 0] = LEAST
    # a gap in seq1 that opened after any column k costs opened + (j - k - 1) * extend
    src = np.maximum(m, d)[..., :-1] + opened - extend - slope[:-1]
    i = np.maximum(np.maximum.accumulate(src, axis=-1) + slope[1:], 0)
    i = np.concatenate((np.full_like(M[..., :1], LEAST), i), axis=-1)
    return m, i, d


def affine_scores(one: list[str], two: list[str], match: int, mismatch: int, gap_open: int, gap_extend: int) -> np.ndarray:
    """Local scores with affine gaps."""
    out = np.zeros(len(one), dtype=np.int64)
    for part in _batches(one, two):
        a, m = _codes([one[i] for i in part], -1)
        b, n = _codes([two[i] for i in part], -2)
        width = b.shape[1] + 1
        slope = np.arange(width, dtype=np.int64) * gap_extend
        inside = np.arange(width) <= n[:, None]
        M = np.zeros((len(part), width), dtype=np.int64)
        I = np.full_like(M, LEAST)
        D = np.full_like(M, LEAST)
        best = np.zeros(len(part), dtype=np.int64)
        for i in range(a.shape[1]):
            M, I, D = _affine_row(M, I, D, np.where(b == a[:, i, None], match, mismatch), gap_open + gap_extend, gap_extend, slope)
            top = np.where(inside, np.maximum(np.maximum(M, I), D), 0).max(axis=1)
            best = np.where(i < m, np.maximum(best, top), best)
        out[part] = best
    return out


class _Rows:
    """All rows of one pair's cells, of which every few are kept and the others filled again when asked for."""

    def __init__(self, first: tuple[np.ndarray, ...], advance, m: int) -> None:
        width = len(first[0]) * len(first)
        self.step = 1 if (m + 1) * width <= CELLS else max(1, int((m + 1) ** 0.5))
        self.advance, self.m = advance, m
        self.kept, self.first, self.block_at = {0: first}, first, -1

    def forward(self):
        """Rows 1 to m in order."""
        row = self.first
        for i in range(1, self.m + 1):
            row = self.advance(row, i)
            if i % self.step == 0:
                self.kept[i] = row
            yield i, row

    def __getitem__(self, i: int) -> tuple[np.ndarray, ...]:
        if i in self.kept:
            return self.kept[i]
        at = i // self.step * self.step
        if at != self.block_at:
            row, self.block, self.block_at = self.kept[at], {}, at
            for j in range(at + 1, min(at + self.step, self.m + 1)):
                row = self.block[j] = self.advance(row, j)
        return self.block[i]


def _linear_rows(one: str, two: str, match: int, mismatch: int, gap: int, floor: bool) -> tuple[_Rows, np.ndarray, np.ndarray]:
    a, b = _codes([one], -1)[0][0], _codes([two], -2)[0][0]
    slope = np.arange(len(b) + 1, dtype=np.int64) * gap
    first = np.zeros(len(b) + 1, dtype=np.int64) if floor else slope.copy()

    def advance(state: tuple[np.ndarray, ...], i: int) -> tuple[np.ndarray, ...]:
        row = state[0]
        u = row + gap
        np.maximum(u[1:], row[:-1] + np.where(b == a[i - 1], match, mismatch), out=u[1:])
        if floor:
            np.maximum(u, 0, out=u)
        return (np.maximum.accumulate(u - slope) + slope,)

    return _Rows((first,), advance, len(a)), a, b


def _walk(rows: _Rows, one: str, two: str, i: int, j: int, match: int, mismatch: int, gap: int, floor: bool) -> tuple[str, str]:
    """From a cell back: a diagonal step, else a gap in seq2, else a gap in seq1."""
    x, y = [], []
    while (i > 0 and j > 0 and rows[i][0][j] > 0) if floor else (i > 0 or j > 0):
        if i > 0 and j > 0 and rows[i][0][j] == rows[i - 1][0][j - 1] + (match if one[i - 1] == two[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(one[i])
            y.append(two[j])
        elif i > 0 and (j == 0 or rows[i][0][j] == rows[i - 1][0][j] + gap):
            i -= 1
            x.append(one[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(two[j])
    return "".join(reversed(x)), "".join(reversed(y))


def global_strings(one: str, two: str, match: int, mismatch: int, gap: int) -> tuple[str, str, int]:
    rows, _, _ = _linear_rows(one, two, match, mismatch, gap, False)
    score = len(two) * gap
    for _, row in rows.forward():
        score = int(row[0][-1])
    return *_walk(rows, one, two, len(one), len(two), match, mismatch, gap, False), score


def local_strings(one: str, two: str, match: int, mismatch: int, gap: int) -> tuple[str, str, int]:
    rows, _, _ = _linear_rows(one, two, match, mismatch, gap, True)
    best, at = 0, (0, 0)
    for i, row in rows.forward():
        j = int(row[0].argmax())
        if row[0][j] > best:
            best, at = int(row[0][j]), (i, j)
    return *_walk(rows, one, two, *at, match, mismatch, gap, True), best


def affine_strings(one: str, two: str, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[str, str, int]:
    """The last best cell, taken in the order M, I, D; the state before a gap's step is the one that explains its cell."""
    a, b = _codes([one], -1)[0][0], _codes([two], -2)[0][0]
    opened = gap_open + gap_extend
    slope = np.arange(len(b) + 1, dtype=np.int64) * gap_extend
    none = np.full(len(b) + 1, LEAST, dtype=np.int64)

    def advance(state: tuple[np.ndarray, ...], i: int) -> tuple[np.ndarray, ...]:
        return _affine_row(*state, np.where(b == a[i - 1], match, mismatch), opened, gap_extend, slope)

    rows = _Rows((np.zeros(len(b) + 1, dtype=np.int64), none, none), advance, len(a))
    best, at = 0, (0, 0, 0)
    for i, row in rows.forward():
        if len(b) == 0:
            continue
        cells = np.stack(row, axis=1)[1:].ravel()  # by column, then M, I, D
        last = len(cells) - 1 - int(cells[::-1].argmax())
        if cells[last] >= best:
            best, at = int(cells[last]), (i, last // 3 + 1, last % 3)
    i, j, state = at
    x, y = [], []
    M, I, D = 0, 1, 2
    while i > 0 and j > 0 and rows[i][state][j] > 0:
        value = rows[i][state][j]
        if state == M:
            above, step = rows[i - 1], match if one[i - 1] == two[j - 1] else mismatch
            i, j = i - 1, j - 1
            x.append(one[i])
            y.append(two[j])
            state = next((s for s in (M, I, D) if value == above[s][j] + step), None)
        elif state == I:
            row = rows[i]
            j -= 1
            x.append("-")
            y.append(two[j])
            state = next((s for s in (M, I, D) if value == row[s][j] + (gap_extend if s == I else opened)), None)
        else:
            above = rows[i - 1]
            i -= 1
            x.append(one[i])
            y.append("-")
            state = next((s for s in (M, D, I) if value == above[s][j] + (gap_extend if s == D else opened)), None)
        if state is None:
            break
    return "".join(reversed(x)), "".join(reversed(y)), best
