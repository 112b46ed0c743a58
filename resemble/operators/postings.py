"""Postings (A4) and one-vs-many scoring by postings.

For a large corpus the array form of J1 ships every document's token set to
each pair.  The postings form joins *distinct* ``(doc, token)`` rows with the
main documents' postings on the token, counts the overlap per pair with
partial aggregation, and takes set sizes from a per-document count.  The
pairs themselves come from the check list (as in J1) by an equi-join on the
sub key, so documents sharing nothing with their main stay, with overlap 0.

Hot tokens ("the" is in every document) sit on the corpus side only; the
main side has one row per (main, token).  When the mains' postings are few
(checked with a bounded count) they are broadcast, so hot tokens never
shuffle; otherwise AQE's skew join splits the hot partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.functions.tokens import explode_items, with_tokens
from resemble.operators.checks import MAX_BROADCAST_MAINS, _bounded_mains, rank_results
from resemble.session import BROADCAST_BYTES, broadcast_within, materialize

MAX_BROADCAST_POSTINGS = 2_000_000
#: bytes of a piece of the mains' index, and cells that a worker counts at one time
PIECE_BYTES = 32 << 20
CELLS = 4 << 20


def token_sets(corpus: DataFrame, key: str = "key", text: str = "content", **tok) -> DataFrame:
    """``(key, s)``: each document's distinct tokens (narrow, no shuffle)."""
    toks = with_tokens(corpus.select(key, text), text, "_t", **tok)
    return toks.select(key, F.array_distinct("_t").alias("s"))


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``limit`` rows that take at most ``BROADCAST_BYTES``; both are counted where the rows are."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= BROADCAST_BYTES else df


def set_similarity(metric: str, inter: Column, na: Column, nb: Column) -> Column:
    """M1/M2 from set sizes: the same formulas and rounding as the array form."""
    if metric == "cosine":
        v = F.round(inter / (F.sqrt(na) * F.sqrt(nb)) * 100, 2)
        return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(v)
    if metric == "jaccard":
        union = na + nb - inter
        return F.when(union == 0, F.lit(0.0)).otherwise(F.round(inter / union * 100, 2))
    raise ValueError("postings scoring supports cosine and jaccard")


def overlap_counts(main_sets: DataFrame, doc_sets: DataFrame) -> DataFrame:
    """``(check_id, key, inter)`` for every pair sharing at least one token.

    ``main_sets``: ``(check_id, s)``; ``doc_sets``: ``(key, s)``.
    """
    main_post = explode_items(main_sets, ["check_id"], "s", "token")
    main_post = bounded_broadcast(main_post, MAX_BROADCAST_POSTINGS)
    doc_post = explode_items(doc_sets, ["key"], "s", "token")
    return doc_post.join(main_post, "token").groupBy("check_id", "key").agg(F.count(F.lit(1)).alias("inter"))


def one_vs_many_postings(checks: DataFrame, corpus: DataFrame, metric: str = "cosine",
                         max_broadcast_mains: int = MAX_BROADCAST_MAINS, **tok) -> DataFrame:
    """J1's result computed by postings (same columns, same values for cosine/jaccard).

    ``checks``: ``(check_id, main_key, sub_key)``; ``corpus``: ``(key, content, error)``.
    """
    checks = checks.select("check_id", "main_key", "sub_key").dropDuplicates(["check_id", "main_key", "sub_key"])
    keys = _bounded_mains(checks, max_broadcast_mains)
    main_src = corpus if keys is None else corpus.where(F.col("key").isin(keys))
    mains = checks.select("check_id", "main_key").distinct()
    main_info = mains.join(
        token_sets(main_src, **tok).join(main_src.select("key", "content", "error"), "key")
        .withColumnRenamed("key", "main_key"), "main_key", "left")
    main_sets = main_info.select("check_id", F.coalesce("s", F.array().cast("array<string>")).alias("s"))
    main_meta = main_info.select("check_id", F.size(F.coalesce("s", F.array())).alias("mn"),
                                 F.col("main_key").alias("mk"), (F.col("content") == "").alias("m_empty"),
                                 F.col("error").alias("m_error"), F.col("s").isNull().alias("m_missing"))
    doc_sets = materialize(token_sets(corpus, **tok))
    inter = overlap_counts(main_sets, doc_sets).withColumnRenamed("key", "sub_key")
    sizes = doc_sets.select(F.col("key").alias("sub_key"), F.size("s").alias("sn"))
    errors = corpus.select(F.col("key").alias("sub_key"), F.col("error").alias("s_error"))
    meta = main_meta if keys is None else broadcast_within(main_meta)
    known = sizes.join(errors, "sub_key").withColumn("s_known", F.lit(True))
    pairs = checks.join(known, "sub_key", "left").join(meta, "check_id") \
        .join(inter, ["check_id", "sub_key"], "left")
    error = F.when(F.col("m_missing") | F.col("m_error").isNotNull(), F.lit("Main page not found")) \
        .when(F.col("m_empty"), F.lit("Main page is empty")) \
        .when(F.col("s_error").isNotNull() | F.col("s_known").isNull(), F.lit("Page not found"))
    sim = set_similarity(metric, F.coalesce("inter", F.lit(0)), F.col("mn"), F.col("sn"))
    out = pairs.select("check_id", "sub_key", F.when(error.isNull(), sim).cast("double").alias("similarity"),
                       error.alias("error"))
    return rank_results(out)


def _packed_index(keys: pa.Array, sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(tokens, bounds, mains, sizes)``: sorted distinct tokens, where each one's mains begin, their numbers, their set sizes."""
    sizes = np.diff(sets.offsets.to_numpy())
    flat = sets.flatten().to_numpy(zero_copy_only=False)
    mains = np.repeat(np.arange(len(keys)), sizes)
    order = np.lexsort((mains, flat))
    tokens, first = np.unique(flat[order], return_index=True)
    return tokens, np.append(first, len(flat)), mains[order], sizes


def _index_bytes(main_sets: DataFrame) -> int:
    """Bytes of the packed index of ``(key, h)``, counted on the executors."""
    return main_sets.agg(F.coalesce(F.sum(F.size("h") * 24 + 64), F.lit(0))).first()[0]


def _index_pieces(main_sets: DataFrame, pieces: int) -> Iterator[tuple[pa.Array, tuple]]:
    """The mains' keys and packed index in so many pieces, dealt by a hash of the key."""
    for i in range(pieces):
        part = main_sets if pieces == 1 else main_sets.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == i)
        rows = part.toArrow().combine_chunks()
        if rows.num_rows:
            sets = rows.column("h").combine_chunks()
            yield rows.column("key").combine_chunks(), _packed_index(rows.column("key"), sets)


def _overlaps(values: np.ndarray, offsets: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, main, count)`` of every pair of a batch that shares a token: the mains' lists of each document's tokens, merged by counting."""
    tokens, bounds, mains, sizes = index
    n_mains, docs = len(sizes), len(offsets) - 1
    place = np.minimum(np.searchsorted(tokens, values), max(len(tokens) - 1, 0))
    known = np.flatnonzero(tokens[place] == values) if len(tokens) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, known, "right") - 1
    lists, length = bounds[place[known]], np.diff(bounds)[place[known]] if len(tokens) else np.zeros(0, np.int64)
    out = []
    step = max(1, CELLS // max(n_mains, 1))
    for lo in range(0, docs, step):
        hi = min(lo + step, docs)
        a, b = np.searchsorted(doc, [lo, hi])
        k = length[a:b]
        at = np.repeat(lists[a:b], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        counts = np.bincount(np.repeat(doc[a:b] - lo, k) * n_mains + mains[at], minlength=(hi - lo) * n_mains)
        some = np.flatnonzero(counts)
        out.append((some // n_mains + lo, some % n_mains, counts[some]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def many_mains_overlap(mains: DataFrame, corpus: DataFrame, metric: str = "cosine", threshold: float = 0.0,
                       piece_bytes: int = PIECE_BYTES, **tok) -> DataFrame:
    """J9 with many mains: ``(main_key, sub_key, inter, similarity)`` for every pair that
    shares a token and scores at least ``threshold``.

    ``mains``: ``(key, content)``, e.g. benchmark items; ``corpus``: ``(key, content)``.

    The mains become a packed inverted index (token hash → numbers of the mains),
    in pieces whose bytes are counted first, so what is broadcast is bounded.  A
    document meets all mains of a piece at once: the lists of its tokens are merged
    by counting, so overlaps are exact, nothing is shuffled, and only pairs that
    pass the threshold leave the worker.  With several pieces the documents'
    sets are computed once and read once a piece.
    """
    spark = corpus.sparkSession
    from resemble.operators.simjoin import hashed_sets

    main_sets = materialize(hashed_sets(mains, **tok))
    doc_sets = hashed_sets(corpus, **tok)
    out_schema = T.StructType([T.StructField("main_key", mains.schema["key"].dataType), T.StructField("sub_key", corpus.schema["key"].dataType),
                               *[T.StructField(c, T.LongType()) for c in ("inter", "_na", "_nb")]])
    pieces = max(1, math.ceil(_index_bytes(main_sets) / piece_bytes))
    if pieces > 1:
        doc_sets = materialize(doc_sets)
    least = (threshold - 0.005) / 100 - 1e-9
    found = []
    for keys, index in _index_pieces(main_sets, pieces):
        shared = spark.sparkContext.broadcast((keys, index))

        def score(batches, shared=shared):
            keys, index = shared.value
            for batch in batches:
                sets = batch.column(1)
                offsets = sets.offsets.to_numpy() - sets.offsets[0].as_py()
                doc, main, inter = _overlaps(sets.flatten().to_numpy(zero_copy_only=False), offsets, index)
                na, nb = index[3][main], np.diff(offsets)[doc]
                whole = np.sqrt(na * nb) if metric == "cosine" else na + nb - inter
                near = inter >= least * whole
                doc, main = doc[near], main[near]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(main)), batch.column(0).take(pa.array(doc)), *[pa.array(x[near].astype(np.int64)) for x in (inter, na, nb)]],
                    names=[f.name for f in out_schema])

        found.append(doc_sets.mapInArrow(score, out_schema))
    pairs = spark.createDataFrame([], out_schema) if not found else found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    sim = set_similarity(metric, F.col("inter"), F.col("_na"), F.col("_nb"))
    return pairs.select("main_key", "sub_key", "inter", sim.alias("similarity")).where(F.col("similarity") >= threshold)
