"""Hard negatives by a secondary-sort shuffle.

1.  Vectors are quantised to integers; a pair's score is the integer inner
    product.  Anchors are a stated query set (ids divisible by ``every``).  They
    go to the executors in blocks of ``block`` anchors, and each block meets
    all rows, a slice of rows at a time.
2.  Every partition gives, for each anchor, its best ``positives`` rows of the
    anchor's label.  Packed into keys (anchor, descending score, id), they are
    shuffled by anchor and sorted on the way (``repartitionAndSortWithinPartitions``);
    an iterator passes on the first ones of each anchor.
3.  With an anchor's positive scores known, a partition gives, for each of
    them, the best ``negatives`` rows of other labels inside its window.  A row
    outside these cannot be among the first of the whole table, so this loses
    nothing and what is shuffled is bounded by anchors and partitions, not by
    pairs.
4.  Positives and those negatives are shuffled with keys (anchor, descending
    score, positives first, id).  An iterator goes through the sorted pairs: a
    positive opens a window, each later negative goes to the open windows that
    hold its score, and a window closes with its last negative.  Its state is
    one anchor's open windows, so no anchor is ever materialised.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; a shorter vector counts as padded with zeros; a row is
never paired with its own id; of anchor rows with the same id the least by label
and vector is taken, other repeated rows each count; scores and components must
fit a 64-bit integer, else the job ends with an overflow error; an empty table
gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
from pyspark import RDD, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.llm.graph import dropped, stored

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: a negative's score is within these percentages of the positive's
LOW_PERCENT, HIGH_PERCENT = 80, 100
SCALE = 256
#: anchors that are on the executors at one time, and rows that meet them at one time
ANCHOR_BLOCK = 2_048
ROW_SLICE = 2_048
#: a double holds every integer below
EXACT = 1 << 53

OUT = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()),
                    T.StructField("rank", T.IntegerType()), T.StructField("negative_id", T.LongType()),
                    T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE) -> DataFrame:
    """``(id, label, q)``: the rows that take part, components as ``floor(scale * x)``."""
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # comparisons with null are null: a null component makes the test null, which the filter refuses
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.where("id is not null and label is not null and v is not null").where(finite).select(
        "id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :min(len(v), width)] = v[:width]
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if max(abs(int(exact.min())), abs(int(exact.max()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit a 64-bit integer")
    return exact.astype(np.int64)


def _slices(rows: Iterable, width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, labels, vectors)`` of so many rows at a time; components beyond the anchors' width meet zeros."""
    ids, labels, vectors = [], [], []
    for row in rows:
        ids.append(row[0])
        labels.append(row[1])
        vectors.append(row[2])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(labels, np.int64), _matrix(vectors, width)
            ids, labels, vectors = [], [], []
    if ids:
        yield np.array(ids, np.int64), np.array(labels, np.int64), _matrix(vectors, width)


def _best(held: list, scores: np.ndarray, ids: np.ndarray, keep: int) -> list:
    """The first ``keep`` of the held pairs and the new ones, as ``(-score, id)`` in order."""
    if not len(scores):
        return held
    if len(held) == keep:
        near = scores >= -held[-1][0]
        scores, ids = scores[near], ids[near]
    if len(scores) > keep:
        # all that tie with the last one stay until ids decide
        near = scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep]
        scores, ids = scores[near], ids[near]
    return sorted(held + list(zip((-scores).tolist(), ids.tolist())))[:keep]


def _local_positives(rows: Iterable, anchors: Broadcast, keep: int, size: int) -> Iterator[tuple]:
    """Keys ``(anchor, -score, id)`` of a partition's best rows of each anchor's label."""
    ids, labels, vectors = anchors.value[:3]
    held: list[list] = [[] for _ in ids]
    for row_ids, row_labels, row_vectors in _slices(rows, vectors.shape[1], size):
        for label in np.unique(row_labels):
            mine, like = np.flatnonzero(labels == label), row_labels == label
            scores = _inner(vectors[mine], row_vectors[like])
            for a, line in zip(mine, scores):
                other = row_ids[like] != ids[a]
                held[a] = _best(held[a], line[other], row_ids[like][other], keep)
    for a, pairs in enumerate(held):
        for minus, row in pairs:
            yield (int(ids[a]), minus, row), None


def _local_negatives(rows: Iterable, anchors: Broadcast, keep: int, size: int, low: int, high: int) -> Iterator[tuple]:
    """Keys ``(anchor, -score, 1, id)`` of a partition's best rows of other labels inside the window of each positive."""
    ids, labels, vectors, windows = anchors.value
    held: dict[tuple[int, int], list] = {(a, score): [] for a, found in enumerate(windows) for score in found}
    for row_ids, row_labels, row_vectors in _slices(rows, vectors.shape[1], size):
        scores = _inner(vectors, row_vectors)
        other = (labels[:, None] != row_labels[None, :]) & (ids[:, None] != row_ids[None, :])
        for (a, score), pairs in held.items():
            inside = other[a] & _in_window(scores[a], score, low, high)
            held[a, score] = _best(pairs, scores[a][inside], row_ids[inside], keep)
    most: dict[tuple, int] = {}
    for (a, _), pairs in held.items():
        # windows overlap: a row goes as often as it is in the table
        for pair in set(pairs):
            most[a, pair] = max(most.get((a, pair), 0), pairs.count(pair))
    for (a, (minus, row)), times in most.items():
        for _ in range(times):
            yield (int(ids[a]), minus, 1, row), None


def _in_window(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """``low * positive <= 100 * score <= high * positive``, without a product that could overflow."""
    return (scores >= -((-low * positive) // 100)) & (scores <= (high * positive) // 100)


def _first(pairs: Iterable, keep: int) -> Iterator[tuple]:
    """The first ``keep`` of each anchor from sorted keys ``(anchor, -score, id)``."""
    anchor, n = None, 0
    for (a, minus, row), _ in pairs:
        if a != anchor:
            anchor, n = a, 0
        n += 1
        if n <= keep:
            yield (a, minus, 0, row), None


def _windows(pairs: Iterable, keep: int, low: int, high: int) -> Iterator[tuple]:
    """Result rows from sorted keys ``(anchor, -score, 0 for a positive, id)``; open windows are the only state."""
    anchor, open_windows = None, []
    for (a, minus, kind, row), _ in pairs:
        if a != anchor:
            anchor, open_windows = a, []
        score = -minus
        if kind == 0:
            open_windows.append([row, score, 0])
            continue
        # scores fall from here on: a window that has ended or is full holds no later row
        open_windows = [w for w in open_windows if w[2] < keep and 100 * score >= low * w[1]]
        for window in open_windows:
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield a, window[0], window[2], row, window[1], score


def _by_anchor(key: tuple) -> int:
    """Anchors have a common divisor, so their number itself would leave most partitions empty."""
    return crc32(b"%d" % key[0])


def _blocks(spark, anchors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Anchors in blocks of ``size`` by range of id: no more than one block is on the driver."""
    last = None
    while True:
        rest = anchors if last is None else anchors.where(F.col("id") > last)
        rows = rest.orderBy("id").limit(size).collect()
        if not rows:
            return
        yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
        last = rows[-1][0]
        if len(rows) < size:
            return


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW_PERCENT, high: int = HIGH_PERCENT, block: int = ANCHOR_BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``(id, label, q)`` rows.

    ``high`` must be at most 100, so that a positive's negatives come after it in order of score.
    """
    if high > 100:
        raise ValueError("a negative cannot score above its positive")
    spark = rows.sparkSession
    rows = stored(rows.select("id", "label", "q"))
    anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "q")).alias("m")).select("id", "m.label", "m.q")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for ids, labels, vectors in _blocks(spark, anchors, block):
        matrix = _matrix(vectors, max(map(len, vectors)))
        shared = spark.sparkContext.broadcast((ids, labels, matrix))
        best = _positives(rows.rdd, shared, positives, parts).collect()
        shared.unpersist()
        windows = _scores(ids, best)
        shared = spark.sparkContext.broadcast((ids, labels, matrix, windows))
        near = rows.rdd.mapPartitions(lambda it, shared=shared: _local_negatives(it, shared, negatives, ROW_SLICE, low, high))
        pairs = spark.sparkContext.parallelize(best, 1).union(near)
        in_order = pairs.repartitionAndSortWithinPartitions(min(parts, len(ids)), _by_anchor)
        out = in_order.mapPartitions(lambda it: _windows(it, negatives, low, high))
        found.append(stored(spark.createDataFrame(out, OUT)))
        shared.unpersist()
    dropped(rows)
    if not found:
        return spark.createDataFrame([], OUT)
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _positives(rows: RDD, anchors: Broadcast, keep: int, parts: int) -> RDD:
    """Keys ``(anchor, -score, 0, id)`` of the first ``keep`` rows of each anchor's label."""
    near = rows.mapPartitions(lambda it: _local_positives(it, anchors, keep, ROW_SLICE))
    return near.repartitionAndSortWithinPartitions(min(parts, len(anchors.value[0])), _by_anchor).mapPartitions(lambda it: _first(it, keep))


def _scores(ids: np.ndarray, best: list) -> list[list[int]]:
    """The distinct positive scores of each anchor of the block."""
    found: dict[int, set] = {}
    for (a, minus, _, _), _ in best:
        found.setdefault(a, set()).add(-minus)
    return [sorted(found.get(int(a), ())) for a in ids]
