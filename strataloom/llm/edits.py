"""Edit distances of many pairs of strings at once, bit-parallel (Myers 1999, in blocks as by Hyyrö 2003)."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Pairs worked on at a time.
CHUNK = 2048
_ONE, _TOP, _ALL = np.uint64(1), np.uint64(63), ~np.uint64(0)


def distances(data: tuple[np.ndarray, np.ndarray], start: tuple[np.ndarray, np.ndarray], size: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Edit distance of string i of the first and of the second side, for all i.

    Each side is one flat array of codes below 256, with the start and the length of each string in it.
    """
    n = len(size[0])
    out = np.zeros(n, np.int64)
    start, size = _unlike(data, start, size)
    # the shorter string is the pattern; pairs of like length are worked on together
    swap = size[0] > size[1]
    m, long = np.minimum(*size), np.maximum(*size)
    order = np.lexsort((long, m))
    flat = np.concatenate(data).astype(np.uint8)
    at = (start[0], start[1] + len(data[0]))
    short_at, long_at = np.where(swap, at[1], at[0]), np.where(swap, at[0], at[1])
    seen = np.flatnonzero(np.bincount(flat, minlength=256))
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(len(seen))
    flat = code[flat]
    for i in range(0, n, CHUNK):
        r = order[i : i + CHUNK]
        out[r] = _chunk(flat, short_at[r], m[r], long_at[r], long[r], len(seen))
    return out


def _unlike(data: tuple[np.ndarray, np.ndarray], start: tuple[np.ndarray, np.ndarray], size: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """Start and size without what both strings begin or end with (64 codes at most), which no distance depends on."""
    windows = [sliding_window_view(np.concatenate([np.zeros(64, np.uint8), d, np.zeros(64, np.uint8)]), 64) for d in data]
    least = np.minimum(*size)
    before = after = np.zeros(len(least), np.int64)
    if len(least):
        # an extra column that differs ends the search
        unlike = np.ones((len(least), 65), bool)
        unlike[:, :64] = windows[0][start[0] + 64] != windows[1][start[1] + 64]
        before = np.minimum(unlike.argmax(1), least)
        unlike[:, :64] = (windows[0][start[0] + size[0]] != windows[1][start[1] + size[1]])[:, ::-1]
        after = np.minimum(unlike.argmax(1), least - before)
    return (start[0] + before, start[1] + before), (size[0] - before - after, size[1] - before - after)


def _chunk(flat: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, letters: int) -> np.ndarray:
    """The distance is what the last column's differences from row to row sum up to, so it need not be
    followed from letter to letter."""
    rows, width = len(m), int(m.max())
    blocks = max(1, -(-width // 64))
    # each letter of a pattern sets a bit of its own, so adding them up sets all
    peq = np.zeros((blocks, letters * rows), np.uint64)
    row = np.repeat(np.arange(rows), m)
    i = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    np.add.at(peq.reshape(-1), flat[a[row] + i] * rows + row + (i >> 6) * peq.shape[1], _ONE << (i & 63).astype(np.uint64))
    base = np.arange(rows)
    # rows leave from the end as their text is used up
    order = np.argsort(-n, kind="stable")
    m, b, n, base = m[order], b[order], n[order], base[order]
    pv, mv = np.full((blocks, rows), _ALL), np.zeros((blocks, rows), np.uint64)
    eq, xv, xh, ph, mh, more, less = np.empty((7, rows), np.uint64)
    for live, j in zip(np.searchsorted(-n, -np.arange(int(n.max())), "left").tolist(), range(int(n.max()))):
        at = flat[b[:live] + j]
        at *= rows
        at += base[:live]
        e, x, y, h, g, up, down = eq[:live], xv[:live], xh[:live], ph[:live], mh[:live], more[:live], less[:live]
        for w in range(blocks):
            p, q = pv[w, :live], mv[w, :live]
            np.take(peq[w], at, out=e, mode="clip")
            np.bitwise_or(e, q, out=x)
            if w:
                e |= down
            # xh = (((eq & p) + p) ^ p) | eq, ph = q | ~(xh | p), mh = p & xh
            np.bitwise_and(e, p, out=y)
            y += p
            y ^= p
            y |= e
            np.bitwise_or(y, p, out=h)
            np.invert(h, out=h)
            h |= q
            np.bitwise_and(p, y, out=g)
            carry = up.copy() if w else _ONE
            into = down.copy() if w else None
            if w + 1 < blocks:
                np.right_shift(h, _TOP, out=up)
                np.right_shift(g, _TOP, out=down)
            h <<= _ONE
            h |= carry
            g <<= _ONE
            if w:
                g |= into
            np.bitwise_or(x, h, out=p)
            np.invert(p, out=p)
            p |= g
            np.bitwise_and(h, x, out=q)
    score = n.copy()
    for w in range(blocks):
        inside = np.clip(m - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, _ALL, (_ONE << (inside & _TOP)) - _ONE)
        score += np.bitwise_count(pv[w] & mask).astype(np.int64) - np.bitwise_count(mv[w] & mask).astype(np.int64)
    out = np.empty_like(score)
    out[order] = score
    return out
