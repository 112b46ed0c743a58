"""Whole-batch word splitting and 64-bit word hashes with numpy.

A batch of texts is one UTF-8 byte buffer with offsets, as Arrow stores it.
Words are maximal runs of bytes of a 256-entry byte class; A-Z counts as a-z.
Every step is one array operation over the buffer, so the cost per text byte
is a few nanoseconds and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers have inverses modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words are runs of anything but space and \x09-\x0D
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: words are runs of ASCII letters, digits and any non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive row ranges of about ``max_bytes``; null is empty.

    A range holds one text at least, so one very long text is a range of its own.
    """
    col = column.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    _, off_buf, data_buf = col.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, bounds)``: 64-bit word hashes, byte starts, and per text ``bounds[i]:bounds[i+1]`` of its words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = is_word[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE_INV)]))
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds.

    A text of fewer than ``width`` words, but not none, has one shingle: its whole sequence.
    """
    n_docs = len(bounds) - 1
    counts = np.diff(bounds)
    n_sh = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(n_docs), n_sh)
    if len(doc) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + np.repeat(bounds[:-1], n_sh)
    h = np.zeros(len(doc), np.uint64)
    size = np.minimum(np.repeat(counts, n_sh), width)
    for k in range(width):
        inside = k < size
        h[inside] = mix(h[inside] * np.uint64(0xD6E8FEB86659FD93) + words[at[inside] + k] + np.uint64(k + 1))
    cuts = np.concatenate([[0], np.cumsum(n_sh)])
    for i in np.flatnonzero(n_sh > 1):
        h[cuts[i]:cuts[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))
