"""Words of whole texts as numpy arrays: one vectorised pass over an Arrow string buffer.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is what ``[^\\x20\\x09-\\x0D]+`` matches in UTF-8.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


class Words(NamedTuple):
    """buf: the UTF-8 bytes; start, end: of each word in buf; first: index of each
    document's first word (one more entry than documents)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string array (null: empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def split(texts: pa.Array) -> Words:
    buf, offs = buffer_of(texts)
    n = len(buf)
    word = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[buf], out=word[:n])
    begins = word[:n].copy()
    begins[1:] &= ~word[: n - 1] if n else begins[1:]
    inner = offs[1:-1][offs[1:-1] < n]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    ends = word[:n] & ~word[1:]
    cut = inner[inner > 0] - 1
    ends[cut] = word[cut]
    end = np.flatnonzero(ends) + 1
    return Words(buf, start, end, np.searchsorted(start, offs))


@lru_cache(maxsize=4)
def _table(lower: bool) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        back = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, _U), np.full(size, back, _U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower: A-Z count as a-z.

    Polynomial hash modulo 2^64 over random byte values, by prefix sums, then mixed."""
    n = len(words.buf)
    if not len(words.start):
        return np.zeros(0, _U)
    up, down = _grown(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_table(lower)[words.buf] * up[:n], dtype=_U, out=total[1:])
    value = (total[words.end] - total[words.start]) * down[words.start]
    return mix64(value + (words.end - words.start).astype(_U) * _U(0xA0761D6478BD642F))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the concatenation of two hashed pieces (order counts)."""
    x = a * _U(0x9E3779B97F4A7C15 + 2 * salt)
    x ^= x >> _U(29)
    x += b
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def doubled(h: np.ndarray, have: int, want: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``want`` (at most 2 * have) words, from those of ``have``
    words: entry i joins the windows at i and at i + want - have. Shorter by want - have."""
    step = want - have
    return pair(h[: len(h) - step], h[step:], salt) if step < len(h) else h[:0]


def windows(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` words by doubling."""
    have = 1
    while have < length:
        want = min(2 * have, length)
        h = doubled(h, have, want, salt + have)
        have = want
    return h
