"""Result ordering (W3) and row numbers without a single-partition window.

``row_number().over(partitionBy(check_id))`` puts every row of one check into
one task; a one-vs-all check holds the whole corpus in one key.  Nothing here
has a window over a key:

``row_numbers``
    rows are range-partitioned in the wanted order (bounds from a sample), each
    range is sorted and numbered by itself, and a range's numbers start after
    the rows of the ranges before it.  Only one row a range meets in one task.
``competition_rank``
    RANK() (ties share a rank) needs the number of rows with a strictly better
    score.  Scores that are rounded to two decimals in [0, 100] take at most
    10,002 values a check, so their histogram is small: partial aggregation,
    and a window over a check's histogram.  Raw scores have no such bound:
    their histogram is itself range-partitioned, summed range by range, and
    started from the sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resemble.session import materialize

MESSAGE_SCORE = float("inf")
#: the number of a row inside its range is in the lower bits of its id, the range above them
_IN_RANGE = 33


def order_score(similarity: Column, error: Column) -> Column:
    """Sort key of W3: message rows first (they sort above any number), then similarity."""
    # never null (coalesce with a literal): no ``isnotnull`` is inferred on the join
    # key, which Catalyst would push below the projection and so score twice
    return F.coalesce(F.when(error.isNotNull(), F.lit(MESSAGE_SCORE)).otherwise(similarity), F.lit(-1.0))


def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted in ranges, with ``_range`` and ``_at``, the row's place in it; computed once, so all readers see the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(rows.withColumn("_range", F.shiftright("_id", _IN_RANGE))
                       .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _IN_RANGE) - 1))).drop("_id"))


def _starts(ranges: DataFrame, amount: Column) -> DataFrame:
    """``(_range, _start)``: what the ranges before each one hold; one row a range, as many as shuffle partitions at most."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(amount.cast("long").alias("_n"))
    return F.broadcast(sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))


def row_numbers(df: DataFrame, order: list[Column], out: str = "number") -> DataFrame:
    """``df`` with ``out``, the row's number from 1 on in ``order`` over the whole table.

    Rows that are equal in ``order`` are numbered in any order; ``df`` is computed
    more than once (the bounds come from a sample), so cheap or materialised.
    """
    ranges = _in_ranges(df, order)
    numbered = ranges.join(_starts(ranges, F.count(F.lit(1))), "_range")
    return numbered.withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def consecutive(df: DataFrame, order: list[str], columns: dict[str, list[str]], group: str | None = None) -> DataFrame:
    """Each row with the ones that follow it in ``order``, gaps in the keys or not.

    ``columns`` maps a column of ``df`` to its names in the row itself, the next one
    and so on; rows of another ``group`` do not follow.
    """
    steps = max(map(len, columns.values()))
    keep = list(dict.fromkeys([*([group] if group else []), *columns]))
    rows = materialize(row_numbers(df.select(*dict.fromkeys([*keep, *order])), [F.col(c) for c in ([group] if group else []) + order], "_number"))
    out = None
    for step in range(steps):
        side = rows.select((F.col("_number") - step).alias("_number"), *([F.col(group)] if group else []),
                           *[F.col(c).alias(names[step]) for c, names in columns.items() if len(names) > step])
        out = side if out is None else out.join(side, ["_number", *([group] if group else [])])
    return out.drop("_number")


def competition_rank(df: DataFrame, part_cols: list[str], score: str, out: str = "rank", rounded: bool = True) -> DataFrame:
    """Add ``out`` = 1 + number of rows in the same partition with a higher ``score``.

    ``score`` must be non-null.  Equivalent to SQL ``rank() over (partition by
    part_cols order by score desc)``.  ``rounded``: the scores take few values.
    """
    hist = df.groupBy(*part_cols, score).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part_cols).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    if rounded:
        hist = hist.select(*part_cols, score, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("int").alias(out))
        return df.join(hist, on=[*part_cols, score], how="inner")
    ranges = _in_ranges(hist, [*[F.col(c) for c in part_cols], F.col(score).desc()])
    # a running sum inside a range, which is one task's sorted rows
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    higher = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(_starts(ranges, F.sum("_n")), "_range")
    higher = higher.select(*part_cols, score, (F.col("_start") + F.col("_before")).alias("_before"))
    # what comes before a partition's first score belongs to other partitions
    first = higher.groupBy(*part_cols).agg(F.min("_before").alias("_first"))
    ranks = higher.join(first, part_cols).select(*part_cols, score, (F.col("_before") - F.col("_first") + 1).cast("int").alias(out))
    return df.join(ranks, on=[*part_cols, score], how="inner")
