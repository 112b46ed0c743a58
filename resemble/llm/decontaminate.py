"""Benchmark decontamination by FM-indexes over shards of the training texts.

A window is ``window`` consecutive words of a benchmark item (a shorter item,
but not an empty one, is one window).  Executors index their own shard of the
texts, search all windows backwards through wavelet ranks, locate the
occurrences by sampled suffix positions and merge them into word spans.

Only runs of words that all occur in the benchmark can hold a window, so a
shard's index covers those runs; every other word is a separator.  That drops
no match: it is decided word by word over the whole text.

The benchmark side is a stated query set.  It is taken in blocks of windows of
at most ``block_bytes`` of words each; a block is collected and broadcast, and
the texts pass through one step per block, so no block grows with the
benchmark or with the texts.

Defined results: null text has no words; rows keep their order and repeats; a
null item or text of the benchmark is ignored (a null id counts as the string
'null'); an empty benchmark hits nothing; columns of the input that clash with
the added ones are replaced.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.llm.fm_index import FmIndex
from resemble.llm.wordhash import ALNUM, split_words, text_slices

#: fixed by the contract: words after A-Z is lower-cased
WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
BLOCK_BYTES = 8 << 20
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(words, items)``: every distinct window and the sorted ids (as strings) of the items that hold it."""
    words = F.array_remove(F.split(F.translate(F.col("text"), UPPER, LOWER_AZ), WORD_BREAK), "")
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"), words.alias("_w"))
    windows = F.when(F.size("_w") <= window, F.array(F.col("_w"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("_w") - window + 1), lambda i: F.slice("_w", i, window)))
    # explode_outer and a filter on its result: an inner explode would evaluate the words twice
    rows = items.select("_item", F.explode_outer(windows).alias("words")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("_item")).alias("items"))


def _blocks(windows: DataFrame, block_bytes: int):
    """Windows in blocks whose words take about ``block_bytes``, split by a hash of the window."""
    sized = windows.withColumn("_bytes", F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")))
    total = sized.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))
    for i in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i)
        rows = part.select("words", "items").orderBy("words").collect()
        if rows or i == 0:
            yield [(list(r[0]), list(r[1])) for r in rows]


def _hash_words(words: list[str]) -> np.ndarray:
    col = pa.array(words, pa.large_string())
    out = [split_words(data, offsets, ALNUM)[0] for _, _, data, offsets in text_slices(col)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block(rows: list) -> SimpleNamespace:
    """One block of windows as symbol rows, right-aligned; symbol = rank of the word's hash + 1."""
    lengths = np.array([len(w) for w, _ in rows], np.int64)
    flat = _hash_words([x for w, _ in rows for x in w])
    vocab = np.unique(flat)
    wide = int(lengths.max()) if len(rows) else 1
    patterns = np.zeros((len(rows), wide), np.int64)
    col = np.concatenate([np.arange(wide - k, wide) for k in lengths]) if len(rows) else np.zeros(0, np.int64)
    patterns[np.repeat(np.arange(len(rows)), lengths), col] = np.searchsorted(vocab, flat) + 1
    return SimpleNamespace(vocab=vocab, patterns=patterns, lengths=lengths, items=[i for _, i in rows],
                           shortest=int(lengths.min()) if len(rows) else 1)


def _runs(symbols: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all runs of ``shortest`` known words or more, a 0 after each, and each symbol's word index (-1: the 0s)."""
    known = symbols > 0
    head = known.copy()
    head[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    tail = known.copy()
    tail[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    keep = ends - starts >= shortest
    starts, size = starts[keep], (ends - starts)[keep]
    out_end = np.cumsum(size + 1)
    total = int(out_end[-1]) if len(out_end) else 0
    seq, word = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(out_end - size - 1, size) + inner
    word[at] = np.repeat(starts, size) + inner
    seq[at] = symbols[word[at]]
    return seq, word


def _search_shard(block: SimpleNamespace, data: np.ndarray, offsets: np.ndarray):
    """Per text of one shard: its number of words, its merged hit spans and the items found."""
    hashes, _, bounds = split_words(data, offsets, ALNUM)
    n_docs = len(offsets) - 1
    counts = np.diff(bounds)
    spans, items = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)]
    if not len(hashes) or not len(block.vocab):
        return counts, spans, items
    doc = np.repeat(np.arange(n_docs), counts)
    place = np.minimum(np.searchsorted(block.vocab, hashes), len(block.vocab) - 1)
    symbols = np.where(block.vocab[place] == hashes, place + 1, 0)
    seq, word = _runs(symbols, doc, block.shortest)
    if not len(seq):
        return counts, spans, items
    index = FmIndex(seq)
    which, low, high = index.search(block.patterns, block.lengths)
    if not len(which):
        return counts, spans, items
    number = high - low
    rows = np.repeat(low, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    pattern = np.repeat(which, number)
    start = word[index.locate(rows)]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + block.lengths[pattern], -1)
    hit = np.cumsum(change[:-1]) > 0
    head, tail = hit.copy(), hit.copy()
    head[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
    tail[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
    for s, e in zip(np.flatnonzero(head), np.flatnonzero(tail) + 1):
        spans[doc[s]].append((int(s - bounds[doc[s]]), int(e - bounds[doc[s]])))
    for d, p in np.unique(np.stack([doc[start], pattern], axis=1), axis=0):
        items[d].update(block.items[p])
    return counts, spans, items


def _merge(spans: list) -> list:
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                   text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged word ranges ``[start, end)``) and ``items`` (sorted ids)."""
    spark = docs.sparkSession
    added = [f.name for f in _ADDED]
    out = docs.drop(*added)
    base = out.schema
    schema = T.StructType(list(base.fields) + list(_ADDED.fields))
    kinds = {"n_words": pa.int64(), "hit_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
             "items": pa.list_(pa.string())}
    for number, rows in enumerate(_blocks(benchmark_windows(benchmark, window), block_bytes)):
        shared = spark.sparkContext.broadcast(_block(rows))

        def step(batches, shared=shared, first=number == 0):
            block = shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for lo, hi, data, offsets in text_slices(texts):
                    part = batch.slice(lo, hi - lo)
                    counts, spans, items = _search_shard(block, data, offsets)
                    keep = part.columns if first else part.columns[:-3]
                    if not first:
                        old_spans, old_items = part.columns[-2].to_pylist(), part.columns[-1].to_pylist()
                        spans = [[(x["start"], x["end"]) for x in o] + s for o, s in zip(old_spans, spans)]
                        items = [set(o) | i for o, i in zip(old_items, items)]
                    new = [pa.array(counts, kinds["n_words"]),
                           pa.array([[{"start": s, "end": e} for s, e in _merge(x)] for x in spans], kinds["hit_spans"]),
                           pa.array([sorted(x) for x in items], kinds["items"])]
                    yield pa.RecordBatch.from_arrays(list(keep) + new, names=[f.name for f in schema])

        out = out.mapInArrow(step, schema)
    return out


def hit_words() -> "F.Column":
    """Number of words inside any occurrence, from ``hit_spans``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def judged(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: hit at all, and at least a twentieth of the words are hit."""
    n_hit = hit_words()
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns and texts unchanged."""
    return judged(find_benchmark(docs, benchmark, window)).where(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])
