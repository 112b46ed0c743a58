"""Merging Burrows-Wheeler transforms of shards by interleave refinement.

A shard is a set of byte strings, each closed by the byte ``CLOSE``.  The rows
of its transform are the cyclic rotations of its strings in order.  Merging
starts from the shards one after the other.  A round deals the interleaved
rows stably by the two bytes that precede each and steps to the rows that
begin there, which refines the order by two more bytes, so ``depth / 2``
rounds suffice for intervals of equal ``depth``-byte prefixes.  Suffixes are
not sorted again.  A row alone in its interval stays alone, and so do the rows
before it: such rows are left out of later rounds.
"""

from __future__ import annotations

import numpy as np

CLOSE = 0xFF  # never a byte of UTF-8


class Shard:
    """Sorted rotations of the strings of one shard: ``order`` (positions) and the two bytes before each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, depth: int):
        """``data``: the strings, each with its closing byte; ``bounds``: their places."""
        n = len(data)
        size = np.diff(bounds)
        start = np.repeat(bounds[:-1], size)
        length = np.repeat(size, size)
        offset = np.arange(n) - start

        def rotated(by: int) -> np.ndarray:
            return start + (offset + by) % length

        step = rotated(1)
        key, at = data.astype(np.uint64), step
        for _ in range(7):
            key = (key << np.uint64(8)) | data[at]
            at = step[at]
        _, rank = np.unique(key, return_inverse=True)
        width = 8
        bits = n.bit_length()
        while width < depth:
            # as many ranks as fit in 63 bits make the next one
            many = max(min(63 // bits, -(-depth // width)), 2)
            key = rank.astype(np.int64)
            for k in range(1, many):
                key = (key << bits) | rank[rotated(k * width)]
            _, rank = np.unique(key, return_inverse=True)
            width *= many
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        back = rotated(-2)
        before = data[back].astype(np.uint16) << np.uint16(8) | data[rotated(-1)]
        self.before = before[self.order]
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        #: row of the rotation that begins two bytes earlier
        self.earlier = place[back[self.order]]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, block)``: the rows (numbered through the shards' orders) that share their ``depth``-byte prefix with
    another row, in the merged order, and the number of the interval that each is in; ``depth`` is even."""
    base = np.concatenate([[0], np.cumsum([len(s.order) for s in shards])]).astype(np.int32)
    before = np.concatenate([s.before for s in shards])
    earlier = np.concatenate([s.earlier + b for s, b in zip(shards, base)])
    rows = np.arange(len(before), dtype=np.int32)
    block = np.zeros(len(rows), np.int32)
    for _ in range(depth // 2):
        symbol = before[rows]
        deal = np.argsort(symbol, kind="stable")
        symbol, block, rows = symbol[deal], block[deal], earlier[rows[deal]]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new[:-1], dtype=np.int32)
        shared = ~(new[:-1] & new[1:])
        rows, block = rows[shared], block[shared]
    return rows, block
