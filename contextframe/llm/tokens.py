"""Words of Arrow string columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and U+0009..U+000D, the
class ``[^\\x20\\x09-\\x0D]+``.  Its hash is a polynomial over random values of
its bytes; prefix sums give all words of a buffer at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20
BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = BASE if kind == "up" else pow(BASE, -1, 1 << 64)
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds.astype(np.int64)


def blocks(bounds: np.ndarray, size: int = CHUNK):
    """Ranges of whole rows of about ``size`` bytes."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """(hashes, first): a hash per word and where each row's words begin, one entry more than rows."""
    hashes, first, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in blocks(bounds):
        h, f, _, _ = words_block(data, bounds, lo, hi, lower)
        hashes.append(h)
        first.append(f[1:] + total)
        total += len(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(first)


def words_block(data, bounds, lo, hi, lower=False, space=SPACE, heads=()):
    """As words() for rows lo..hi, with each word's byte range in ``data``; ``space`` marks the bytes between words.

    With ``heads``, hashes has a row per word: the word's and those of its first
    so many bytes, 0 for words that are no longer than that.
    """
    at = int(bounds[lo])
    seg = data[at : int(bounds[hi])]
    if lower:
        seg = LOWER[seg]
    rows = bounds[lo : hi + 1] - at
    n = len(seg)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(heads)) if heads else 0, np.uint64), np.zeros(hi - lo + 1, np.int64), none, none
    solid = ~space[seg]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edge = rows[:-1][rows[:-1] < n]
    begin[edge] = solid[edge]
    edge = rows[1:][rows[1:] > 0] - 1
    stop[edge] = solid[edge]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[seg] * _power("up", n)[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * _power("down", n)[s] + (e - s).astype(np.uint64))
    if heads:
        part = [np.where(e - s > k, mix((sums[np.minimum(s + k, e)] - sums[s]) * _power("down", n)[s] + np.uint64(k << 32)), np.uint64(0)) for k in heads]
        h = np.stack([h, *part], 1)
    return h, np.searchsorted(s, rows), s + at, e + at


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive entries, at its first entry."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : n + k]
        out ^= out >> np.uint64(29)
    return mix(out)
