"""Structured Streaming forms: frontier (X2), job progress (X3), check.

Each stream reads a table as a file stream, runs to completion with an
``availableNow`` trigger (so it can also run as a scheduled incremental job),
and writes to a folder under the shared ``spark.checkpoint.dir``; its
checkpoint sits next to it, so a restarted job resumes where it stopped and a
lost executor only re-runs its tasks.

X2 keeps, per key, only the time of the last fetch as state
(``applyInPandasWithState``): one long per key, whatever the key's traffic.
Within a micro-batch a key's rows are sorted by event time; a row arriving in
a later batch with an older time is judged against the newer state (no
reordering across batches), so ``frontier_in_time_order`` gives a whole log to
the stream in slices of time.  ``dropDuplicatesWithinWatermark`` is not the same
rule: its expiry is driven by the watermark, not by the fetch time.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from resemble.session import checkpoint_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table of ``sf_dir`` as a file stream (schema taken from the batch read).

    ``maxFilesPerTrigger`` bounds each micro-batch, and so the rows one key's
    state function sees at once.
    """
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("basePath", base) \
        .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{base}/{name}*.parquet")


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", foreach_batch=None, path: str | None = None) -> DataFrame:
    """Run ``stream`` until its input is consumed; return what it wrote as a batch DataFrame.

    ``path`` holds the output and the stream's checkpoint; a later run with the
    same path resumes there.  Without it the run gets a folder of its own.
    """
    spark = stream.sparkSession
    root = path.rstrip("/") if path else _run_dir(spark, name)
    out = f"{root}/data"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint") \
        .trigger(availableNow=True)
    if foreach_batch is not None:
        writer = writer.foreachBatch(lambda df, epoch: foreach_batch(df, epoch, out))
        q = writer.start()
    else:
        q = writer.format("parquet").start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


# --- X2 -----------------------------------------------------------------------------

FRONTIER_SCHEMA = "key long, event_id long, ts timestamp"
FRONTIER_STATE = "t0 long"


def _frontier_fn(ttl_us: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["t", "event_id"], kind="stable")
        times = pdf["t"].to_numpy()
        # from miss to miss: the next one is the first access at or after the end of this one's life
        misses = []
        at = int(times.searchsorted(state.get[0] + ttl_us)) if state.exists else 0
        while at < len(times):
            misses.append(at)
            at = max(int(times.searchsorted(times[at] + ttl_us)), at + 1)
        if misses:
            state.update((int(times[misses[-1]]),))
        # an entry whose life is over is no entry: nothing is lost when it goes
        ends = (state.get[0] + ttl_us) // 1000 + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        hit = pdf.iloc[misses]
        yield pd.DataFrame({"key": hit["key"].astype("int64"), "event_id": hit["event_id"].astype("int64"),
                            "ts": hit["ts"]})

    return fn


def frontier_stream(log: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int, late: str = "1 day") -> DataFrame:
    """The accesses that are misses (fetches), emitted as they arrive.

    A key's state goes once the watermark (the latest event time less ``late``)
    passes the end of its entry's life, so the state holds live entries only.
    Events that come later than ``late`` are dropped, as with any watermark.
    """
    rows = log.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"),
                      F.col(ts).cast("timestamp").alias("ts"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(
        _frontier_fn(ttl_seconds * 1_000_000), FRONTIER_SCHEMA, FRONTIER_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def frontier_in_time_order(log: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int, files_per_slice: int = 16) -> DataFrame:
    """X2 over a whole log, whatever the order of its files.

    The log is cut into slices of time, of about ``files_per_slice`` of its files each; rows of one time are in one
    slice. The slices are given to the stream one after the other, the next one when the last one's rows are done. So
    no row comes after a later slice's, and the watermark drops none.
    """
    spark = log.sparkSession
    root = _run_dir(spark, "frontier")
    n = -(-len(log.inputFiles()) // files_per_slice)
    log = log.select(key, ts, event_id)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = log.agg(F.percentile_approx(t, [i / n for i in range(1, n)])).first()[0] or [] if n > 1 else []
    place = F.lit(0)
    for cut in sorted(set(cuts)):
        place = place + F.coalesce((t > cut).cast("int"), F.lit(0))
    log.withColumn("slice", place).write.partitionBy("slice").parquet(f"{root}/slices")
    parts = spark.read.parquet(f"{root}/slices")
    for i in sorted(r[0] for r in parts.select("slice").distinct().collect()):
        # one batch: the files of a slice are in no order
        parts.where(F.col("slice") == i).drop("slice").coalesce(files_per_slice).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        out = run_to_table(frontier_stream(stream, key, ts, event_id, ttl_seconds), "frontier", path=root)
    return out if n else spark.createDataFrame([], FRONTIER_SCHEMA)


# --- X3 -----------------------------------------------------------------------------

def progress_stream(job_rows: DataFrame) -> DataFrame:
    """Running per-job counts over a stream of ``(job_id, kind)`` events."""
    return job_rows.groupBy("job_id").agg(
        F.count(F.when(F.col("kind") == "row", 1)).alias("progress"),
        (F.count(F.when(F.col("kind") == "finish", 1)) > 0).alias("finish"))


def write_progress(batch: DataFrame, epoch: int, out: str) -> None:
    """foreachBatch body for X3 in update mode: the jobs that changed, a folder per epoch, so a retry replaces its own."""
    batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def latest_progress(changes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each job's newest counts next to its size; jobs without a row have no progress."""
    newest = changes.groupBy("job_id").agg(F.max(F.struct("epoch", "progress", "finish")).alias("r")).select("job_id", "r.progress", "r.finish")
    return newest.join(sizes, "job_id", "right").select(
        "job_id", "size", F.coalesce("progress", F.lit(0)).alias("progress"),
        F.when(F.col("size") == 0, F.lit(0.0))
        .otherwise(F.round(F.coalesce("progress", F.lit(0)) / F.col("size") * 100, 0)).alias("complete"),
        F.coalesce("finish", F.lit(False)).alias("finish"))
