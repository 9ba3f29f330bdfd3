"""Vectorised text kernels that run inside tasks: words, hashes and word n-grams of an Arrow column.

Words are runs of bytes other than space and \\t..\\r.  Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up, down = (np.full(m, b % (1 << 64), U64) for b in (_MUL[which], pow(_MUL[which], -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if m <= 1 << 23:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def pieces(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and each row's first word (one more entry than rows)."""
    word = ~_SPACE[buf]
    n = len(buf)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    up, down = powers(len(buf) + 1, which)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_MUL[1 - which]))


def ngrams(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of words[i : i + k] for each i, across rows too; see ``inside`` for those that stay in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(words) + 1, which)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word windows that lie in one row, and their rows."""
    row = row_of(first)
    i = np.arange(len(row))
    ok = i + k <= first[1:][row]
    return i[ok], row[ok]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i."""
    if len(x) < w:
        return x[:0]
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def words_of(text: str | None) -> list[bytes]:
    """The words of one text; bytes.split() parts at just these six bytes."""
    return (text or "").encode().split()
