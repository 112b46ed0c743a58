"""Document fingerprints: a threshold-scaled sketch of word shingles.

A text's shingles are its runs of ``WIDTH`` words (a shorter text has one, its
whole sequence).  The sketch keeps every 64-bit shingle hash below a fixed
fraction of the hash range, so its size follows the text's, the sketch of a
union is the union of the sketches, and containment is estimated between texts
of very different sizes.  A text whose hashes all lie above keeps its smallest
one, so only a text without words has an empty sketch.

Native only.  Defined results: null text counts as empty; an empty sketch is
the empty string; two empty sketches are alike to 1, an empty and another to 0.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resemble.llm.graph import small, stored

WIDTH = 5
#: one hash in 2 ** SCALE_BITS is kept
SCALE_BITS = 3
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_ROWS, MAX_BUCKETS = 2_000, 10_000


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH, scale_bits: int = SCALE_BITS) -> DataFrame:
    """Adds the sorted sketch of ``text_col`` as ``array<bigint>``.

    Each step is a projection of its own, so that no step is evaluated once per use.
    """
    w, h, s = f"_{out}_w", f"_{out}_h", f"_{out}_s"
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), SPACE), "")
    df = df.withColumn(w, words).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                       lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(width)]))
    df = df.withColumn(s, F.when(F.size(h) >= width, runs).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
                       .otherwise(F.array().cast("array<bigint>")))
    kept = f"_{out}_k"
    df = df.withColumn(kept, F.filter(s, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0))
    least = F.array_min(F.transform(s, lambda x: F.shiftrightunsigned(x, 1)))
    smallest = F.filter(s, lambda x: F.shiftrightunsigned(x, 1) == least)
    df = df.withColumn(out, F.array_sort(F.array_distinct(
        F.when((F.size(kept) > 0) | (F.size(s) == 0), F.col(kept)).otherwise(smallest))))
    return df.drop(w, h, s, kept)


def as_text(sketch: Column) -> Column:
    """The sketch as hexadecimal numbers joined by commas."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.nullif(union, F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)))


def merged(a: Column, b: Column, scale_bits: int = SCALE_BITS) -> Column:
    """Sketch of the union of two texts' shingles."""
    every = F.array_sort(F.array_union(a, b))
    kept = F.filter(every, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0)
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def _bucket(key: Column, bounds: list) -> Column:
    """Number of ascending ``bounds`` below ``key``; bounds are one literal in rows of about their square root."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    tops = F.from_json(F.lit(json.dumps([r[-1] for r in rows])), "array<bigint>")
    whole = F.size(F.filter(tops, lambda b: b < key))
    part = F.coalesce(F.get(table, whole), F.array().cast("array<bigint>"))
    return whole * step + F.size(F.filter(part, lambda b: b < key))


def with_next(df: DataFrame, id_col: str, tie: str, prepare, carry: list[str]) -> DataFrame:
    """``prepare(df)`` with ``next_<c>`` for each of ``carry``: the value of the next row by descending id, the first's after the last.

    Rows are dealt into ranges of ids, one shuffle; each range also gets a copy
    of the row that follows it.  Null ids come last; rows of equal ids are
    ordered by ``tie``.
    """
    light = df.select(id_col, tie)
    number = light.count()
    n_ranges = min(MAX_BUCKETS, math.ceil(number / BUCKET_ROWS))
    bounds = []
    if n_ranges > 1:
        shares = [i / n_ranges for i in range(1, n_ranges)]
        bounds = sorted(set(light.agg(F.percentile_approx(id_col, shares, 100_000)).first()[0] or []))
    # ranges count down with the id, so that the next range has the next smaller ids; null ids have the last one
    key = F.when(F.col(id_col).isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - _bucket(F.col(id_col), bounds))
    ranged = df.withColumn("_range", key.cast("int"))
    heads = stored(light.withColumn("_range", key.cast("int")).groupBy("_range").agg(
        F.max(F.struct(F.col(id_col).alias("i"), F.col(tie).alias("t"))).alias("m")))
    order = Window.orderBy("_range")  # one row a range
    last = F.last("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = F.coalesce(F.lag("_range").over(order), last)
    copies = stored(heads.select(F.col("m.i").alias("_i"), F.col("m.t").alias("_t"), to.alias("_to")))
    tails = df.join(small(copies), F.col(id_col).eqNullSafe(F.col("_i")) & F.col(tie).eqNullSafe(F.col("_t")))
    tails = tails.dropDuplicates(["_to"]).select(*df.columns, F.col("_to").alias("_range"), F.lit(1).alias("_tail"))
    rows = prepare(ranged.withColumn("_tail", F.lit(0)).unionByName(tails))
    inside = Window.partitionBy("_range").orderBy("_tail", F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carry})
    return rows.where("_tail = 0").drop("_range", "_tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness (see the query's contract).

    The edited text has its last half replaced by as much of the start of the
    next document's, by descending id (after the last: the first).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("tie", F.xxhash64("t"))
    rows = with_next(rows, "id", "tie", lambda r: with_sketch(r, "t", "sk"), ["t", "sk"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half)))
    rows = with_sketch(rows, "edited", "esk")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("esk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"))
