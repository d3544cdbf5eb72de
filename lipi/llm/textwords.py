"""Vectorised word hashing shared by the word-based operators.

Words are maximal runs of bytes other than space and 0x09-0x0D (a UTF-8
continuation byte is never one of these). A word hashes to the polynomial of
its bytes, read off one running sum modulo 2^64, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 1 << 18           # bytes hashed at once (uint64 temporaries: 8 x)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (avalanche), element-wise."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_TAB = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_TAB_LOWER = _TAB[_LOWER]
_CACHE: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _CACHE.get(base)
    if got is None or len(got) < n:
        seq = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        seq[0] = 1
        got = np.multiply.accumulate(seq)
        if len(seq) <= 4 * BLOCK:
            _CACHE[base] = got
    return got


def spans(buf: np.ndarray) -> tuple:
    """Start and end (exclusive) of every word in a byte array."""
    word = np.empty(len(buf) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    np.logical_not(_SEP[buf], out=word[1:-1].view(bool))
    d = np.diff(word)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _hash_block(buf: np.ndarray, start, end, lower: bool) -> np.ndarray:
    n = len(buf)
    x = (_TAB_LOWER if lower else _TAB)[buf] * _powers(_BASE, n)[:n]
    run = np.empty(n + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(x, out=run[1:])
    return mix((run[end] - run[start]) * _powers(_INV, n)[start] + U(1))


def hash_words(buf: np.ndarray, lower: bool = False) -> tuple:
    """(hashes, starts, ends) of the words of a byte array, block by block;
    blocks end at word boundaries, a longer word is a block of its own."""
    start, end = spans(buf)
    if len(buf) <= 2 * BLOCK:
        return _hash_block(buf, start, end, lower), start, end
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        lo, hi = start[i], end[j - 1]
        out.append(_hash_block(buf[lo:hi], start[i:j] - lo, end[i:j] - lo, lower))
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), start, end


def blocks_of(binary_column, size: int = BLOCK):
    """Cut an Arrow binary column into (first row, bytes joined by a space,
    byte offset of every row) blocks of about ``size`` bytes; a longer text
    is a block of its own. Null counts as empty."""
    rows, total, first = [], 0, 0
    values = binary_column.to_pylist()
    for i, v in enumerate(values):
        v = v or b""
        if rows and total + len(v) > size:
            yield _joined(first, rows)
            rows, total, first = [], 0, i
        rows.append(v)
        total += len(v) + 1
    if rows:
        yield _joined(first, rows)


def _joined(first, rows):
    lens = np.array([len(r) for r in rows], dtype=np.int64) + 1
    offs = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(lens, out=offs[1:])
    return first, np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8), offs


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (len(words) - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = len(words)
    x = words * _powers(_BASE, m)[:m]
    run = np.empty(m + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(x, out=run[1:])
    return mix((run[k:] - run[:-k])[:n] * _powers(_INV, m)[:n] + U(k))
