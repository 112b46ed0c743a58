"""Repeated substrings across documents by merged Burrows-Wheeler transforms.

Each byte of a document that lies in a ``LENGTH``-byte string which also starts
in a document with a smaller id is removed.

0.  Of documents with equal text only the one with the smallest id goes on; the
    others lose all their bytes (if there are ``LENGTH``).
1.  Every ``LENGTH``-byte window of a text is anchored at the smallest hash of
    its ``GRAM``-byte strings, so equal windows have equal anchors.  Anchors
    are spread by hash and counted: only windows whose anchor occurs in two
    documents can repeat.  A hash that two different strings share keeps too
    many windows, never too few.
2.  Consecutive windows with one anchor make a region.  Equal regions of a block of
    documents are one; regions are spread by their anchor, so all places of a
    repeated window meet, and a passage in a third of all documents arrives once a block.
3.  There the regions are cut into shards of bounded size, each with its own
    transform; the transforms are merged by interleave refinement, whose
    intervals of equal ``LENGTH``-byte prefixes give each window's smallest document.
4.  Blocks get these back and mark what they remove.

Blocks, spreads and shards have bounded expected sizes at any size of input.
Defined results: null text is empty; rows with equal ids do not remove each
other's bytes; a null id counts as larger than all others; text shorter than
``LENGTH`` bytes stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resemble.llm.bwt import CLOSE, Shard, merge
from resemble.llm.graph import small, stored
from resemble.llm.wordhash import mix, text_slices

LENGTH = 50
GRAM = 24  # a multiple of eight
BLOCK_BYTES = 16 << 20
SPREAD_BYTES = 512 << 10
SHARD_BYTES = 64 << 10
SLICE_BYTES = 256 << 10  # the arrays of a slice stay in a core's cache
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on, eight bytes at a time."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    for r in range(8):
        part = data[r:r + (n - r + 7) // 8 * 8]
        eight[r::8] = np.frombuffer(part.tobytes(), "<u8")
    out = eight[:n - GRAM + 8] * np.uint64(_BASE)
    for k in range(8, GRAM, 8):
        out ^= out >> np.uint64(29)
        out += eight[k:n - GRAM + 8 + k]
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[:len(values) - width + 1], out[width - size:])


def _content_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from running sums of a polynomial."""
    n = len(data)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start[i]``, ``start[i] + 1``, ... of ``size[i]`` each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Regions:
    """Runs of windows with one anchor in a slice of texts: anchor, first byte, number of windows, text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        empty = np.zeros(0, np.int64)
        self.anchor, self.start, self.count, self.doc = np.zeros(0, np.uint64), empty, empty, empty
        if len(data) < LENGTH:
            return
        least = _sliding_min(_gram_hashes(data), LENGTH - GRAM + 1)
        # windows begin in the first bytes of each text; other places belong to no window
        begin, last = offsets[:-1], np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
        edge = np.zeros(len(least) + 1, np.int32)
        np.add.at(edge, begin[last > begin], 1)
        np.add.at(edge, last[last > begin], -1)
        inside = np.cumsum(edge[:-1]) > 0
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[begin[begin < len(least)]] = True
        self.start = np.flatnonzero(inside & change)
        stop = np.ones(len(least), bool)
        stop[:-1] = change[1:] | ~inside[1:]
        self.count = np.flatnonzero(inside & stop) + 1 - self.start
        self.anchor, self.doc = least[self.start], np.searchsorted(offsets, self.start, "right") - 1


def _rows(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of one block, sorted, so that every step sees the block's rows in one order."""
    table = table.select(["id", "t"]).sort_by([("id", "ascending"), ("t", "ascending")])
    ids = pc.fill_null(table.column("id"), NO_ID).to_numpy()
    text = table.column("t").cast(pa.large_string()).combine_chunks()
    return ids, text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)


def _slices(texts: pa.Array):
    """Slices of one block's texts with their regions."""
    for lo, hi, data, offsets in text_slices(texts, SLICE_BYTES):
        yield lo, hi, data, offsets, Regions(data, offsets)


def _short(anchor: np.ndarray) -> np.ndarray:
    """40 bits of an anchor are enough to tell that it may repeat."""
    return anchor >> np.uint64(24)


def _in_two(anchor: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Sorted anchors that occur with two different sources."""
    order = np.argsort(anchor, kind="stable")
    a, s = anchor[order], source[order]
    if not len(a):
        return a
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    low, high = np.minimum.reduceat(s, heads), np.maximum.reduceat(s, heads)
    return a[heads][low != high]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class _Candidates:
    """Distinct regions of one block that may hold a repeated window, numbered by their hashes."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, repeated: np.ndarray):
        self.slices = list(_slices(texts))
        short = [_short(r.anchor) for *_, r in self.slices]
        docs = [ids[lo + r.doc] for lo, _, _, _, r in self.slices]
        local = _in_two(np.concatenate(short), np.concatenate(docs)) if short else np.zeros(0, np.uint64)
        #: per slice: the candidates among its regions, and their documents
        self.which = [np.flatnonzero(_member(s, repeated) | _member(s, local)) for s in short]
        self.own = [d[w] for d, w in zip(docs, self.which)]
        keys = [_content_keys(data, r.start[w], r.start[w] + r.count[w] + LENGTH - 1) if len(w) else np.zeros(0, np.uint64)
                for (_, _, data, _, r), w in zip(self.slices, self.which)]
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        unique, self.first, number = np.unique(every, return_index=True, return_inverse=True)
        self.low = np.full(len(unique), NO_ID, np.int64)
        if len(every):
            np.minimum.at(self.low, number, np.concatenate(self.own))
        self.bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)]).astype(np.int64)
        self.number = [number[a:b] for a, b in zip(self.bounds, self.bounds[1:])]

    def contents(self) -> tuple[np.ndarray, pa.Array]:
        """Anchor and bytes of each distinct region."""
        size, anchor = np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.uint64)
        found = []
        for k, (_, _, data, _, r) in enumerate(self.slices):
            mine = np.flatnonzero((self.first >= self.bounds[k]) & (self.first < self.bounds[k + 1]))
            at = self.which[k][self.first[mine] - self.bounds[k]]
            size[mine], anchor[mine] = r.count[at] + LENGTH - 1, r.anchor[at]
            found.append((mine, r.start[at], data))
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(offsets[-1]), np.uint8)
        for mine, start, data in found:
            out[_spans(offsets[mine], size[mine])] = data[_spans(start, size[mine])]
        return anchor, pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _merged_lows(data: np.ndarray, bounds: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest document over all regions: region, first window and document of each run.

    ``data``: the regions, each closed by ``CLOSE``; ``bounds``: their places; ``low``: their smallest documents.
    """
    part = bounds[:-1] // SHARD_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    shards, places = [], []
    for a, b in zip(cuts, cuts[1:]):
        shard = Shard(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], LENGTH)
        shards.append(shard)
        places.append((shard.order + bounds[a]).astype(np.int32))
    rows, block = merge(shards, LENGTH)
    at = np.concatenate(places)[rows]  # windows that occur twice or more
    size = np.diff(bounds)
    region = np.repeat(np.arange(len(size), dtype=np.int32), size)
    room = np.repeat(bounds[1:], size) - np.arange(len(data)) > LENGTH  # a whole window before the closing byte
    whole = room[at]
    at, block = at[whole], block[whole]
    lows = low[region]
    if len(at):
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        lows[at] = np.repeat(np.minimum.reduceat(lows[at], heads), np.diff(np.append(heads, len(at))))
    head = room.copy()
    head[1:] &= (lows[1:] != lows[:-1]) | (region[1:] != region[:-1])
    start = np.flatnonzero(head)
    return region[start], start - bounds[:-1][region[start]], lows[start]


def _closed(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a binary array, each followed by ``CLOSE``, and their bounds."""
    _, offsets, data = contents.buffers()
    offsets = np.frombuffer(offsets, np.int32)[contents.offset:contents.offset + len(contents) + 1].astype(np.int64)
    size = np.diff(offsets)
    bounds = offsets - offsets[0] + np.arange(len(offsets))
    out = np.full(int(bounds[-1]), CLOSE, np.uint8)
    out[_spans(bounds[:-1], size)] = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return out, bounds


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(values))


_REGION = "spread long, block long, region long, low long, content binary"
_LOWS = "block long, region long, offsets array<int>, lows array<long>, repeated binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row; ``kept`` holds the remaining bytes if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    keyed = rows.select("id", "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), F.col("t")).alias("h2"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    n_spread = max(16, math.ceil(total / SPREAD_BYTES))
    order = F.coalesce("id", F.lit(NO_ID))
    copied = stored(keyed.groupBy("h1", "h2").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "least"))
    keyed = keyed.join(small(copied), (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    copy = F.coalesce(order > F.col("least"), F.lit(False))
    rows = keyed.where(~copy).select("id", "t", F.pmod(F.xxhash64("id", "h1"), F.lit(n_blocks)).alias("block"))
    long = F.octet_length("t") >= LENGTH
    left = F.when(long, F.lit("")).otherwise(F.col("t"))
    copies = keyed.where(copy).select(
        "id", F.octet_length("t").cast("long").alias("n_bytes"), F.when(long, F.octet_length("t")).otherwise(0).cast("long").alias("n_removed"),
        F.when(long, 1).otherwise(0).cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"),
        (F.encode(left, "UTF-8") if with_bytes else F.lit(None).cast("binary")).alias("kept"))

    def anchors(key, table):
        found = [np.unique(_short(r.anchor)) for *_, r in _slices(_rows(table)[1])]
        every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        spread = (every % np.uint64(n_spread)).astype(np.int64)
        order = np.argsort(spread, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], spread[order][1:] != spread[order][:-1]])) if len(every) else np.zeros(0, np.int64)
        parts = np.split((every // np.uint64(n_spread))[order], heads[1:])
        return pa.table({"spread": pa.array(spread[order][heads], pa.int64()),
                         "block": pa.array([key[0].as_py()] * len(heads), pa.int64()),
                         "packed": pa.array([_pack(p) for p in parts] if len(heads) else [], pa.binary())})

    def repeated(key, table):
        blocks = table.column("block").to_numpy()
        parts = [_unpack(x.as_py()) for x in table.column("packed")]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        twice = _in_two(np.concatenate(parts), owner)
        out_b, out_p = [], []
        for b, p in zip(blocks, parts):
            mine = p[_member(p, twice)]
            if len(mine):
                out_b.append(b)
                out_p.append((mine * np.uint64(n_spread) + np.uint64(key[0].as_py())).astype("<u8").tobytes())
        k = len(out_b)
        return pa.table({"block": pa.array(out_b, pa.int64()), "region": pa.array([-1] * k, pa.int64()),
                         "offsets": pa.array([None] * k, pa.list_(pa.int32())), "lows": pa.array([None] * k, pa.list_(pa.int64())),
                         "repeated": pa.array(out_p, pa.binary())})

    def regions(key, left, right):
        c = _candidates(*_rows(left), right)
        anchor, contents = c.contents()
        k = len(c.low)
        return pa.table({"spread": pa.array((mix(anchor) % np.uint64(n_spread)).astype(np.int64), pa.int64()),
                         "block": pa.array(np.full(k, key[0].as_py(), np.int64)), "region": pa.array(np.arange(k), pa.int64()),
                         "low": pa.array(c.low), "content": contents})

    def lows(table):
        coded = pc.dictionary_encode(table.column("content").combine_chunks())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        which = coded.indices.to_numpy()
        low = table.column("low").to_numpy()
        least = np.full(len(coded.dictionary), NO_ID, np.int64)
        np.minimum.at(least, which, low)
        region, first, value = _merged_lows(*_closed(coded.dictionary), least)
        bounds = np.searchsorted(region, np.arange(len(least) + 1))
        # a region whose windows' smallest document is its block's own says nothing new
        news = np.flatnonzero((np.diff(bounds)[which] > 1) | (value[bounds[:-1]][which] != low))
        size = np.diff(bounds)[which[news]]
        runs = _spans(bounds[:-1][which[news]], size)
        return pa.table({
            "block": table.column("block").take(pa.array(news)), "region": table.column("region").take(pa.array(news)),
            "offsets": _lists(first[runs].astype(np.int32), size), "lows": _lists(value[runs], size),
            "repeated": pa.nulls(len(news), pa.binary())})

    def removed(key, left, right):
        ids, texts = _rows(left)
        c = _candidates(ids, texts, right)
        news = right.filter(pc.greater_equal(right.column("region"), 0)).combine_chunks()
        # runs of each region: one for all its windows, or those told
        run_first, run_low = np.zeros(len(c.low), np.int64), c.low
        at, size = np.arange(len(c.low)), np.ones(len(c.low), np.int64)
        if news.num_rows:
            told = news.column("region").to_numpy()
            size[told] = pc.list_value_length(news.column("offsets")).to_numpy()
            at[told] = len(c.low) + np.concatenate([[0], np.cumsum(size[told])[:-1]])
            run_first = np.concatenate([run_first, pc.list_flatten(news.column("offsets")).to_numpy()])
            run_low = np.concatenate([run_low, pc.list_flatten(news.column("lows")).to_numpy()])
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        for (lo, hi, data, offsets, r), w, own, k in zip(c.slices, c.which, c.own, c.number):
            runs = _spans(at[k], size[k])
            one = np.repeat(np.arange(len(k)), size[k])
            begin = r.start[w][one] + run_first[runs]
            last = np.ones(len(runs), bool)
            last[:-1] = one[1:] != one[:-1]
            end = np.where(last, (r.start[w] + r.count[w])[one], np.append(begin[1:], 0)) + LENGTH - 1
            gone = run_low[runs] < own[one]
            cover = np.bincount(begin[gone], minlength=len(data) + 1) - np.bincount(end[gone], minlength=len(data) + 1)
            cover = np.cumsum(cover[:len(data)]) > 0
            head = cover.copy()
            head[1:] &= ~cover[:-1]
            edges = offsets[:-1][np.diff(offsets) > 0]
            head[edges] = cover[edges]
            covered, heads = np.concatenate([[0], np.cumsum(cover)]), np.concatenate([[0], np.cumsum(head)])
            n_bytes.extend(np.diff(offsets).tolist())
            n_removed.extend(np.diff(covered[offsets]).tolist())
            n_spans.extend(np.diff(heads[offsets]).tolist())
            for a, b in zip(offsets[:-1], offsets[1:]):
                rest = data[a:b]
                rest = (rest[~cover[a:b]] if covered[b] > covered[a] else rest).tobytes()
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
        return pa.table({"id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    by_block = rows.groupBy("block")
    twice = (by_block.applyInArrow(anchors, "spread long, block long, packed binary")
             .groupBy("spread").applyInArrow(repeated, _LOWS))
    met = by_block.cogroup(twice.groupBy("block")).applyInArrow(regions, _REGION)
    found = met.groupBy("spread").applyInArrow(lows, _LOWS)
    told = twice.union(found)
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(
        removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.union(copies).withColumnRenamed("id", id_col)


def _pack(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as five bytes each."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :5] = flat
    return out.view("<u8").ravel().astype(np.uint64)


def _candidates(ids: np.ndarray, texts: pa.Array, right: pa.Table) -> _Candidates:
    packed = [x.as_py() for x in right.column("repeated") if x.is_valid]
    repeated = np.sort(np.frombuffer(b"".join(packed), "<u8")).astype(np.uint64)
    return _Candidates(ids, texts, repeated)
