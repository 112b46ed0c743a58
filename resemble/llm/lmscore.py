"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

1.  Tokens are a text's words, lower-cased in A-Z, and one end.  Executors count
    the tokens and the pairs of consecutive tokens (a text's first token follows
    a begin mark) of all training texts; a batch is added up before it is
    shuffled.
2.  A count c is quantised to the level j whose range ``[b^(j-1), b^j)`` holds
    it.  The filter holds the events (n-gram, 1) to (n-gram, j).  It is cut into
    segments by a hash of the n-gram, some ``SEGMENT_KEYS`` n-grams each, which
    executors build one by one; their number follows the corpus.
3.  Workers ask for (n-gram, 1), (n-gram, 2), ... until the filter says no; the
    last yes is the level.  It is never too low, and too high with a chance of
    some ``0.5 ** HASHES`` or less a step.
4.  Probabilities are interpolated: a pair's share among the pairs of its first
    token, and the add-half share of the second token.  A first token that is
    counted c times is taken to have ``c ** beta`` different followers, which
    weigh the second part; ``beta`` makes these add up to the corpus' number of
    distinct pairs.  A score is the sum of log10 over a text's tokens.
5.  The filter is broadcast in blocks of at most ``block_bytes``, whatever the
    size of the corpus.  With one block a text is scored at once.  With more,
    the levels found (two bytes a token) are written next to the texts after
    each block, whose broadcast is then released; the last block's pass scores.
6.  The base score has exact counts: the most frequent tokens, at most
    ``HOT_TOKENS``, are looked up on the worker.  All others leave as distinct
    (text, token) rows, are joined with the table of counts and added up; no
    such token is frequent, so no key is hot.

Tokens are told apart by 64-bit hashes.  Defined results: null text is empty, so
it has its end only; a null id is hashed as the empty string, so it is trained
on; rows with the same id or text are rows of their own; without training texts
every count is 0; an empty table gives an empty table; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resemble.llm.graph import dropped, stored
from resemble.llm.wordhash import NON_SPACE, mix, split_words, text_slices

#: base of the levels, probes an event and bits an event
LEVEL_BASE = 1.5
HASHES = 5
EVENT_BITS = 10
SEGMENT_KEYS = 1 << 19
#: bytes of the filter that are broadcast at one time
BLOCK_BYTES = 128 << 20
HOT_TOKENS = 1 << 18
#: tokens that are added up before they are handed to Spark
BATCH_TOKENS = 2 << 20
SLICE_BYTES = 1 << 20

END = np.uint64(0x2545F4914F6CDD1D)
BEGIN = np.uint64(0x9E6C63D0876A9F25)
_FOLLOWS = np.uint64(0xD6E8FEB86659FD93)
_LEVEL = 0xA0761D6478BD642F
MASK = (1 << 64) - 1


def level_bounds(base: float = LEVEL_BASE) -> np.ndarray:
    """The least count of each level, from level 1 on, for all 64-bit counts."""
    top = math.ceil(63 * math.log(2) / math.log(base))
    return np.array([math.ceil(base ** j) for j in range(top)], np.float64)


def level_counts(base: float = LEVEL_BASE) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    low = level_bounds(base)
    return np.concatenate([[0.0], (low[:-1] + low[1:] - 1) / 2, low[-1:]])


# --- the filter ---------------------------------------------------------------

def _event(keys: np.ndarray, level: int) -> np.ndarray:
    """The hash of the events (key, level)."""
    return mix(keys + np.uint64(level * _LEVEL & MASK))


def _place(events: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of an event's probe among ``size`` bits: the upper half of the hash, moved on by its odd lower half."""
    upper, lower = events >> np.uint64(32), (events & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (((upper + np.uint64(probe) * lower) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def segment_bits(keys: np.ndarray, counts: np.ndarray, base: float = LEVEL_BASE) -> np.ndarray:
    """The bytes of one segment that holds all events of its distinct ``keys``."""
    levels = np.searchsorted(level_bounds(base), counts, "right")
    size = max(64, -(-int(levels.sum()) * EVENT_BITS // 8) * 8)
    flags = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        events = _event(keys[levels >= level], level)
        for probe in range(HASHES):
            flags[_place(events, probe, np.uint64(size))] = True
    return np.packbits(flags, bitorder="little")


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _block(rows: pa.Table, first: int, segments: int) -> tuple:
    """Segments ``first`` and following as one array of bytes: ``(segments, first, bits, start, size)``, the last two in bits."""
    rows = rows.sort_by("seg")
    held = {s: np.frombuffer(b.as_buffer(), np.uint8) for s, b in zip(rows["seg"].to_pylist(), rows["bits"])}
    last = max(held, default=first)
    parts = [held.get(s, np.zeros(8, np.uint8)) for s in range(first, last + 1)]
    size = np.array([len(p) * 8 for p in parts], np.uint64)
    return segments, first, np.concatenate(parts), np.cumsum(size) - size, size


def probe_levels(block: tuple, keys: np.ndarray, found: np.ndarray) -> None:
    """Set ``found`` to the level of each key whose segment is in the block."""
    segments, first, bits, start, size = block
    part = _segment_of(keys, segments).astype(np.int64) - first
    alive = np.flatnonzero((part >= 0) & (part < len(size)))
    level = 0
    while len(alive):
        level += 1
        events, seg = _event(keys[alive], level), part[alive]
        base, width = start[seg], size[seg]
        for probe in range(HASHES):
            at = base + _place(events, probe, width)
            yes = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
            alive, events, base, width = alive[yes], events[yes], base[yes], width[yes]
        found[alive] = level


def _found(block: tuple, distinct: np.ndarray, back: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The levels of keys ``distinct[back]``, each distinct one probed once; those of other blocks as they were."""
    level = np.zeros(len(distinct), np.uint8)
    level[back] = levels
    probe_levels(block, distinct, level)
    return level[back]


# --- tokens -------------------------------------------------------------------

def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(tokens, starts, counts)`` of a slice's texts: hashes of words with an end after each text."""
    words, _, bounds = split_words(data, offsets, NON_SPACE)
    counts = np.diff(bounds) + 1
    ends = np.cumsum(counts)
    tokens = np.full(len(words) + len(counts), END)
    word = np.ones(len(tokens), bool)
    word[ends - 1] = False
    tokens[word] = words
    return tokens, ends - counts, counts


def _pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = BEGIN
    return mix(mix(before) * _FOLLOWS + tokens)


def _single(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ _FOLLOWS)


def _added_up(batches, keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts of some ``BATCH_TOKENS`` tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
            tokens, starts, _ = _sequences(data, offsets)
            held.append(keys_of(tokens, starts))
            n += len(tokens)
            if n >= BATCH_TOKENS:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def token_counts(train: DataFrame) -> DataFrame:
    """``(h, n)``: every distinct token of the texts, by hash, and how often it occurs."""
    def count(batches):
        for keys, n in _added_up(batches, lambda tokens, starts: tokens):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return train.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def filter_segments(train: DataFrame, vocabulary: DataFrame, segments: int, base: float = LEVEL_BASE) -> DataFrame:
    """``(seg, bits, n_keys)``: the filter of all tokens and pairs."""
    names = ["seg", "key", "n"]

    def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        seg = _segment_of(keys, segments).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(seg), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=names)

    def pairs(batches):
        for keys, n in _added_up(batches, _pairs):
            yield rows(keys, n)

    def single(batches):
        for batch in batches:
            yield rows(_single(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), batch.column(1).to_numpy(zero_copy_only=False))

    def build(group: pa.Table) -> pa.Table:
        keys, back = np.unique(group.column("key").to_numpy().view(np.uint64), return_inverse=True)
        counts = np.bincount(back, weights=group.column("n").to_numpy(), minlength=len(keys))
        bits = segment_bits(keys, counts, base)
        return pa.table({"seg": group.column("seg")[:1], "bits": pa.array([bits.tobytes()], pa.binary()), "n_keys": pa.array([len(keys)], pa.int64())})

    schema = "seg int, key long, n long"
    both = train.mapInArrow(pairs, schema).union(vocabulary.mapInArrow(single, schema))
    return both.groupBy("seg").applyInArrow(build, "seg int, bits binary, n_keys long")


# --- statistics ---------------------------------------------------------------

def _by_size(vocabulary: DataFrame) -> list[tuple[int, int, int]]:
    """``(least count, tokens, sum of counts)`` by ranges of counts, a few hundred rows at most, frequent ones first."""
    rows = vocabulary.groupBy(F.floor(F.log2("n") * 4).alias("b")).agg(
        F.min("n").alias("low"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).orderBy(F.col("b").desc()).collect()
    return [(r["low"], r["k"], r["s"]) for r in rows]


def followers_power(sizes: list[tuple[int, int, int]], pairs: int) -> float:
    """``beta`` such that count ** beta, summed over all first tokens, is the number of distinct pairs."""
    low, high = 0.0, 1.0
    for _ in range(50):
        beta = (low + high) / 2
        if sum(k * (s / k) ** beta for _, k, s in sizes) < pairs:
            low = beta
        else:
            high = beta
    return (low + high) / 2


# --- scoring ------------------------------------------------------------------

def _log_probabilities(levels: np.ndarray, starts: np.ndarray, count_of: np.ndarray, texts: int, total: float, beta: float) -> np.ndarray:
    """log10 of each token's probability from the levels of tokens (row 0) and of pairs (row 1)."""
    single, pair = count_of[levels[0]], count_of[levels[1]]
    before = np.empty_like(single)
    before[1:] = single[:-1]
    before[starts] = texts
    alone = (single + 0.5) / total
    followers = np.where(before > 0, before ** beta, 1.0)
    return np.log10((np.minimum(pair, before) + followers * alone) / (before + followers))


def _rare_rows(doc: np.ndarray, tokens: np.ndarray, texts: int) -> pa.ListArray:
    """Per text its distinct tokens with their number, as a list of (h, n)."""
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(doc)))
    rows = pa.StructArray.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(texts + 1)).astype(np.int32)), rows)


_STATE = "id string, held_out boolean, text string, levels binary"
_SCORED = "id string, held_out boolean, n_tokens long, hot_known long, hot_base double, score double, rare array<struct<h:long,n:long>>"


def _pass(state: DataFrame, block, hot, numbers: dict, last: bool) -> DataFrame:
    """One block of the filter over all texts: their levels so far, or on the last block their scores."""
    texts, total, beta, count_of = numbers["texts"], numbers["total"], numbers["beta"], level_counts(numbers["base"])

    def step(batches):
        for batch in batches:
            column, had = batch.column(2), batch.column(3)
            for lo, hi, data, offsets in text_slices(column, SLICE_BYTES):
                tokens, starts, counts = _sequences(data, offsets)
                levels = np.zeros((2, len(tokens)), np.uint8)
                if had[lo].is_valid:
                    for i in range(lo, hi):
                        levels[:, starts[i - lo]:starts[i - lo] + counts[i - lo]] = np.frombuffer(had[i].as_py(), np.uint8).reshape(2, -1)
                distinct, back = np.unique(tokens, return_inverse=True)
                levels[0] = _found(block.value, _single(distinct), back, levels[0])
                levels[1] = _found(block.value, *np.unique(_pairs(tokens, starts), return_inverse=True), levels[1])
                part = batch.slice(lo, hi - lo)
                if not last:
                    cuts = zip(starts, starts + counts)
                    state = pa.array([levels[:, a:b].tobytes() for a, b in cuts], pa.binary())
                    yield pa.RecordBatch.from_arrays(part.columns[:3] + [state], names=["id", "held_out", "text", "levels"])
                    continue
                score = np.add.reduceat(_log_probabilities(levels, starts, count_of, texts, total, beta), starts)
                hot_h, hot_n = hot.value
                place = np.minimum(np.searchsorted(hot_h, distinct), max(len(hot_h) - 1, 0))
                known = hot_h[place] == distinct if len(hot_h) else np.zeros(len(distinct), bool)
                term = np.where(known, np.log10((hot_n[place] + 0.5) / total), 0.0) if len(hot_h) else np.zeros(len(distinct))
                doc, rare = np.repeat(np.arange(len(counts)), counts), ~known[back]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:2] + [pa.array(counts), pa.array(np.add.reduceat(known[back].astype(np.int64), starts)),
                                        pa.array(np.add.reduceat(term[back], starts)), pa.array(score),
                                        _rare_rows(doc[rare], tokens[rare], len(counts))],
                    names=["id", "held_out", "n_tokens", "hot_known", "hot_base", "score", "rare"])

    return state.mapInArrow(step, _SCORED if last else _STATE)


def _filter_blocks(segments_table: DataFrame, segments: int, block_bytes: int) -> Iterator[tuple[tuple, bool]]:
    """Consecutive segments of ``block_bytes`` at most, and whether they are the last."""
    largest = segments_table.agg(F.coalesce(F.max(F.octet_length("bits")), F.lit(8))).first()[0]
    width = max(1, block_bytes // largest)
    for first in range(0, segments, width):
        rows = segments_table.where(F.col("seg").between(first, first + width - 1)).select("seg", "bits").toArrow()
        yield _block(rows, first, segments), first + width >= segments


def held_out_mark(row_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; null counts as the empty string."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % folds == fold


def lm_scores(docs: DataFrame, folds: int = 5, fold: int = 1, base: float = LEVEL_BASE, block_bytes: int = BLOCK_BYTES,
              segment_keys: int = SEGMENT_KEYS, hot_tokens: int = HOT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text, learning from all that are not held out."""
    spark, row_id = docs.sparkSession, F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType
    texts = docs.select(row_id.cast("string").alias("id"), held_out_mark(row_id, folds, fold).alias("held_out"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    train = texts.where("not held_out").select("text")
    vocabulary = stored(token_counts(train))
    sizes = _by_size(vocabulary)
    n_train, n_distinct = sum(s for _, _, s in sizes), sum(k for _, k, _ in sizes)
    segments = max(1, -(-n_train // segment_keys))
    bits = stored(filter_segments(train, vocabulary, segments, base))
    pairs = bits.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0] - n_distinct
    ends = vocabulary.where(F.col("h") == int(END.view(np.int64))).first()
    numbers = {"texts": float(ends["n"]) if ends else 0.0, "total": n_train + 0.5 * (n_distinct + 1),
               "beta": followers_power(sizes, pairs), "base": base}
    # the ranges of counts from the top that hold no more than hot_tokens tokens
    taken, least = 0, None
    for low, k, _ in sizes:
        if taken + k > hot_tokens:
            break
        taken, least = taken + k, low
    found = vocabulary.where(F.col("n") >= (least if least is not None else (1 << 63) - 1)).toArrow()
    hot_h, hot_n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.float64)
    order = np.argsort(hot_h)
    hot = spark.sparkContext.broadcast((hot_h[order], hot_n[order]))

    state, before = texts.withColumn("levels", F.lit(None).cast("binary")), None
    for rows, last in _filter_blocks(bits, segments, block_bytes):
        block = spark.sparkContext.broadcast(rows)
        state = _pass(state, block, hot, numbers, last)
        state = stored(state.withColumn("_row", F.monotonically_increasing_id()) if last else state)
        block.unpersist()
        if before is not None:
            dropped(before)
        before = state
    hot.unpersist()
    dropped(bits)
    total = F.lit(numbers["total"])
    rest = state.select("_row", F.inline("rare")).withColumnRenamed("n", "times")
    rest = rest.join(vocabulary.where(F.col("n") < least) if least is not None else vocabulary, "h", "left")
    sums = rest.groupBy("_row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / total)).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    out = state.drop("rare").join(sums, "_row", "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")
