"""Importance resampling of documents towards a target corpus by hashed n-gram features.

1.  A text is taken as UTF-8 bytes.  One 256-byte table lower-cases A-Z and
    turns every byte that belongs to no word into a space; ``bytes.split``
    gives the words (ASCII letters, digits and all bytes of non-ASCII
    characters).
2.  A feature is a run of 1 to ``max_n`` words, joined by one space.  Its hash
    is crc32: the run of n words goes on from the crc of the run of n - 1 words
    as its seed, so no run is ever joined.  The bucket is the hash modulo
    ``buckets``.
3.  Executors count features with Counters, fold them into one row of bucket
    counts a partition, and Spark adds these up for the raw and for the target
    texts.  A bucket's gain is the thousandfold log ratio of its add-one
    smoothed shares, rounded down.
4.  A document's weight is the sum of the gains of its features.  With the
    Gumbel noise of a hash of its id added, the highest scores are a draw
    without replacement in proportion to the importance weights.
5.  Ranks come from a range partitioning by score: rows are numbered inside
    their range and every range starts after the rows of those before it, so no
    task sees all rows.

Only the ``buckets`` gains (a parameter: 80 kB at 10,000) reach the workers.
Two passes read the texts; a batch is bounded and a text is taken whole.

Defined results: null text is empty, has no features and weight 0; a null id is
hashed as the empty string and comes first among equal scores; repeated rows
stay repeated, each with a rank of its own; an empty target or raw corpus gives
gains by the same formula; an empty table gives an empty table; other columns
of the input are never read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.llm.graph import stored

MAX_N = 1
BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
#: keys of a Counter before it is folded into the bucket counts
FOLD_KEYS = 1 << 16

#: what each byte of a text becomes: itself, its lower case, or a space between words
BYTE_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BYTE_TABLE).split()


def feature_hashes(words: list[bytes], max_n: int):
    """crc32 of every run of 1 to ``max_n`` words joined by a space, shorter runs first."""
    runs = list(map(crc32, words))
    yield runs
    for n in range(1, max_n):
        # the next word extends the run that starts n words before it
        runs = [crc32(word, crc32(b" ", seed)) for word, seed in zip(islice(words, n, None), runs)]
        yield runs


def _texts(batch: pa.RecordBatch, column: int):
    """The batch's texts as bytes, one after the other; null is empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket that has any."""
    def count(batches):
        total, found = np.zeros(buckets, np.int64), Counter()

        def fold():
            at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
            np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
            found.clear()

        for batch in batches:
            for text in _texts(batch, 0):
                for hashes in feature_hashes(words_of(text), max_n):
                    found.update(hashes)
                if len(found) > FOLD_KEYS:
                    fold()
        fold()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    text = F.col(f"`{text_col}`").cast("string").alias("text")
    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; both sides hold ``buckets`` rows at most, so that they are read to the driver."""
    def dense(counts: DataFrame) -> list[int]:
        out = [0] * buckets
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = dense(raw), dense(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(buckets)], np.int64)


def _noise(id_text: Column, seed: str) -> Column:
    """Thousandfold Gumbel noise of the id's hash, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8)
    part = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(part))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N, seed: str = SEED, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score`` in place of columns so named."""
    added = ["n_words", "n_features", "weight", "score"]
    out = docs.drop(*added)
    buckets, text_at = len(gain), out.columns.index(text_col)
    schema = T.StructType(list(out.schema.fields) + [T.StructField(c, T.LongType()) for c in added[:3]])

    def weigh(batches):
        for batch in batches:
            sums = []
            for text in _texts(batch, text_at):
                words, n, weight = words_of(text), 0, 0
                for hashes in feature_hashes(words, max_n):
                    n += len(hashes)
                    weight += int(gain[np.array(hashes, np.int64) % buckets].sum())
                sums.append((len(words), n, weight))
            new = [pa.array([s[i] for s in sums], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(batch.columns + new, names=[f.name for f in schema])

    found = out.mapInArrow(weigh, schema)
    id_text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return found.withColumn("score", F.col("weight") + _noise(id_text, seed))


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with their number from 1 on in ``order``, by ranges of it; ``rows`` must be a stored table.

    The ranges are computed and written once, so that all readers see the same.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of a row in its range is in the lower 33 bits of the id, the range above them
    ranges = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    # one row a range: as many as shuffle partitions at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(starts), "_range").withColumn(out, number).drop("_range", "_at", "_start")


def draw(found: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """Id, counts, weight, score and ``rank`` of every scored document; null for those not drawn."""
    rows = stored(found.select(F.col(f"`{id_col}`").alias(id_col), "n_words", "n_features", "weight", "score"))
    eligible = F.col("n_words") >= least_words
    number = rows.where(eligible).count() * percent // 100
    order = [F.when(eligible, 0).otherwise(1).asc(), F.col("score").desc(), F.col(id_col).asc_nulls_first()]
    out = ranked(rows, order, "rank")
    return out.withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
                        max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every document of ``docs``, weighed by ``target``'s features."""
    gain = gains(bucket_counts(docs, max_n, buckets, text_col), bucket_counts(target, max_n, buckets), buckets)
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return draw(scored(slim, gain, max_n, seed, id_col), percent, least_words, id_col)


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
                    max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, all their columns and whole texts.

    A row is compared with the last one drawn, so nothing is joined; rows that
    equal it in score and id all stay.
    """
    gain = gains(bucket_counts(docs, max_n, buckets, text_col), bucket_counts(target, max_n, buckets), buckets)
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    last = draw(scored(slim, gain, max_n, seed, id_col), percent, least_words, id_col).where("rank is not null").agg(
        F.max_by(F.struct("score", id_col), "rank").alias("m")).first()["m"]
    if last is None:
        return docs.limit(0)
    # the input's own columns come back by their places, so that none clashes
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    found = scored(docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in docs.columns]), gain, max_n, seed, at[id_col], at[text_col])
    score, last_id = last
    row_id = F.col(at[id_col])
    first = row_id.isNull() if last_id is None else row_id.isNull() | (row_id <= last_id)
    stays = (F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & first))
    return found.where(stays).select(*[F.col(at[c]).alias(c) for c in docs.columns])
