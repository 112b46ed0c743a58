"""Batch job progress (A3) and the job list.

The reference keeps one hash per job (size, start, progress, finish) and
increments ``progress`` once per finished row.  Here a job log holds events
``(job_id, kind, size, ts)`` with kinds ``start`` (carrying the row count),
``row`` (one finished row) and ``finish``; the job list is one aggregation
(partial, map-side) and a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_list(events: DataFrame) -> DataFrame:
    """A3 + W5: ``(job_id, start, size, progress, complete, finish)``, newest start first.

    ``complete = round(progress / size · 100)``, 0 when the size is 0.
    """
    agg = events.groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start"),
        F.coalesce(F.max(F.when(F.col("kind") == "start", F.col("size"))), F.lit(0)).cast("long").alias("size"),
        F.count(F.when(F.col("kind") == "row", 1)).alias("progress"),
        (F.count(F.when(F.col("kind") == "finish", 1)) > 0).alias("finish"),
    )
    complete = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.round(F.col("progress") / F.col("size") * 100, 0))
    return agg.select("job_id", "start", "size", "progress", complete.alias("complete"), "finish") \
        .orderBy(F.col("start").desc_nulls_last(), F.col("job_id"))
