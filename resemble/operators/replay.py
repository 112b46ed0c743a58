"""Replay a request log against an expiring cache (batch form).

Per key, in time order: an access is a *miss* (a fetch) when the key was
never fetched or its last fetch is at least ``ttl`` old; a miss re-stamps the
key.  Expiry is fixed from the fetch, not sliding: hits do not extend it.

The rule looks sequential, but the misses of a key are exactly the chain

    first access → next(first) → next(next(first)) → …,

where ``next(a)`` is the first access of the same key at or after
``a.ts + ttl``.  :func:`replay` computes it with no per-key grouping at all, so
a key holding a third of the log is spread over many tasks:

1. ``next`` pointers: accesses and *probes* (one per access, at ``ts + ttl``)
   are range-partitioned and sorted on ``(key, time, probe-first, id)``; each
   partition is scanned once (``mapInPandas``: for a probe, the next access
   row in the same key).  A probe still open at a partition's end is answered
   by the first access of the next partition that has one (one row per
   partition, broadcast).
2. chain marking by pointer doubling: jump tables ``J_{k+1} = J_k ∘ J_k`` are
   equi-joins on the unique access id, and the chain from each key's first
   access is unrolled in ``⌈log2(misses per key)⌉`` rounds.  The number of
   rounds comes from the longest key's time span over ``ttl`` (misses are at
   least ``ttl`` apart).  Every round is checkpointed to the shared folder.

:func:`replay_fold` is the direct per-key fold (``aggregate`` over the key's
sorted accesses); it is kept as an independent check and for small logs.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resemble.session import materialize

_SCAN_SCHEMA = "kind string, pid int, k long, src long, nxt long"


def _scan_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forward scan of one sorted partition: resolve probes to the next access of their key.

    Emits ``('p', pid, k, src, nxt)`` per probe (``nxt`` = -1 when open at the
    partition end with the partition's last key, -2 when no later access can
    exist) and one ``('f', pid, k, -1, id)`` for the partition's first access.
    """
    pending = pd.DataFrame({"k": pd.Series(dtype="int64"), "src": pd.Series(dtype="int64")})
    first_done = False
    pid = None
    last_key = None
    for b in batches:
        if not len(b):
            continue
        pid = int(b["pid"].iloc[0])
        k = b["k"].to_numpy()
        is_ev = b["is_probe"].to_numpy() == 0
        ids = b["id"].to_numpy()
        out = []
        if not first_done and is_ev.any():
            j = int(np.argmax(is_ev))
            out.append(pd.DataFrame({"kind": ["f"], "pid": [pid], "k": [int(k[j])], "src": [-1], "nxt": [int(ids[j])]}))
            first_done = True
        ev_pos = np.flatnonzero(is_ev)
        # probes carried from the previous batch: answered by this batch's first access of their key
        if len(pending):
            if len(ev_pos) and k[ev_pos[0]] == pending["k"].iloc[0]:
                out.append(pending.assign(kind="p", pid=pid, nxt=int(ids[ev_pos[0]])))
                pending = pending.iloc[0:0]
            elif k[0] != pending["k"].iloc[0] or len(ev_pos):
                out.append(pending.assign(kind="p", pid=pid, nxt=-2))
                pending = pending.iloc[0:0]
        pr_pos = np.flatnonzero(~is_ev)
        if len(pr_pos):
            nxt_idx = np.searchsorted(ev_pos, pr_pos)
            has = nxt_idx < len(ev_pos)
            cand = np.where(has, ev_pos[np.minimum(nxt_idx, max(len(ev_pos) - 1, 0))] if len(ev_pos) else 0, -1)
            same = has & (k[np.maximum(cand, 0)] == k[pr_pos]) if len(ev_pos) else np.zeros(len(pr_pos), bool)
            nxt = np.where(same, ids[np.maximum(cand, 0)], -2)
            open_ = ~same & (k[pr_pos] == k[-1])
            done = ~open_
            out.append(pd.DataFrame({"kind": "p", "pid": pid, "k": k[pr_pos][done], "src": ids[pr_pos][done],
                                     "nxt": nxt[done]}))
            if open_.any():
                pending = pd.concat([pending, pd.DataFrame({"k": k[pr_pos][open_], "src": ids[pr_pos][open_]})])
        last_key = k[-1]
        if out:
            yield pd.concat(out)[["kind", "pid", "k", "src", "nxt"]]
    if len(pending):
        yield pending.assign(kind="p", pid=pid, nxt=-1)[["kind", "pid", "k", "src", "nxt"]]
    del last_key


def next_pointers(log: DataFrame, ttl_us: int) -> DataFrame:
    """``(id, nxt)``: for every access, the first access of its key at or after ``ts + ttl`` (null if none).

    ``log``: ``(k long, t long micros, id long)`` with unique ``id``.
    """
    spark = log.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = log.select("k", "t", "id", F.lit(0).alias("is_probe"))
    probes = log.select("k", (F.col("t") + F.lit(ttl_us)).alias("t"), "id", F.lit(1).alias("is_probe"))
    # probes sort before accesses at the same time: "at or after ts + ttl"
    rows = events.unionByName(probes).withColumn("_o", 1 - F.col("is_probe"))
    ordered = rows.repartitionByRange(parts, "k", "t", "_o", "id").sortWithinPartitions("k", "t", "_o", "id") \
        .withColumn("pid", F.spark_partition_id())
    scanned = materialize(ordered.select("k", "t", "is_probe", "id", "pid").mapInPandas(_scan_partition, _SCAN_SCHEMA))
    # open probes: the first access of the next partition that has one, if it is of the same key.
    # One row per partition, so this window and broadcast are bounded by the partition count.
    firsts = scanned.where(F.col("kind") == "f").select("pid", F.struct(F.col("k").alias("fk"), F.col("nxt").alias("fid"))
                                                        .alias("self"))
    follow = scanned.select("pid").distinct().join(firsts, "pid", "left").select(
        "pid", F.min(F.when(F.col("self").isNotNull(), F.struct("pid", "self")))
        .over(Window.orderBy("pid").rowsBetween(1, Window.unboundedFollowing)).alias("n"))
    probes = scanned.where(F.col("kind") == "p")
    fixed = probes.join(F.broadcast(follow), "pid", "left").select(
        F.col("src").alias("id"),
        F.when(F.col("nxt") >= 0, F.col("nxt"))
        .when((F.col("nxt") == -1) & (F.col("n.self.fk") == F.col("k")), F.col("n.self.fid"))
        .alias("nxt"))
    return fixed


def replay(log: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int) -> DataFrame:
    """``(key, event_id, ts, miss)`` for every access in ``log`` (distributed; see module doc)."""
    ttl_us = ttl_seconds * 1_000_000
    base = materialize(log.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(event_id).cast("long").alias("id"),
                                  F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))
    nodes = materialize(next_pointers(base.select("k", "t", "id"), ttl_us))
    roots = base.groupBy("k").agg(F.min(F.struct("t", "id")).alias("r")).select(F.col("r.id").alias("id"))
    span = base.groupBy("k").agg((F.max("t") - F.min("t")).alias("s")).agg(F.max("s")).first()[0] or 0
    max_misses = span // ttl_us + 1
    rounds = max(1, math.ceil(math.log2(max_misses + 1)))
    jumps = [nodes]
    for _ in range(rounds - 1):
        j = jumps[-1]
        nxt = j.alias("a").join(j.alias("b"), F.col("a.nxt") == F.col("b.id"), "left") \
            .select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt"))
        jumps.append(materialize(nxt))
    marked = roots
    for j in reversed(jumps):
        step = marked.join(j, "id").where(F.col("nxt").isNotNull()).select(F.col("nxt").alias("id"))
        # checkpointed: the next round reads ``marked`` twice, so an unmaterialised
        # chain would be recomputed 2^rounds times
        marked = materialize(marked.unionByName(step).distinct())
    out = base.join(marked.withColumn("miss", F.lit(True)), "id", "left")
    return out.select(F.col("k").alias(key), F.col("id").alias(event_id), F.col("ts").alias(ts),
                      F.coalesce("miss", F.lit(False)).alias("miss"))


def replay_fold(log: DataFrame, key: str, ts: str, event_id: str, ttl_seconds: int) -> DataFrame:
    """The same result by a per-key fold: each key's accesses are held by one task."""
    secs = F.unix_micros(F.col(ts).cast("timestamp"))
    per_key = log.select(F.col(key).alias("k"), F.struct(secs.alias("t"), F.col(event_id).alias("id"),
                                                          F.col(ts).alias("ts")).alias("e")) \
        .groupBy("k").agg(F.array_sort(F.collect_list("e")).alias("es"))
    ttl = ttl_seconds * 1_000_000
    # the fold keeps only the miss ids: misses are at least ``ttl`` apart
    init = F.struct(F.lit(None).cast("long").alias("t0"), F.array().cast("array<long>").alias("misses"))

    def step(acc, e):
        miss = acc["t0"].isNull() | (e["t"] >= acc["t0"] + F.lit(ttl))
        return F.struct(F.when(miss, e["t"]).otherwise(acc["t0"]).alias("t0"),
                        F.when(miss, F.concat(acc["misses"], F.array(e["id"].cast("long"))))
                        .otherwise(acc["misses"]).alias("misses"))

    folded = per_key.select("k", "es", F.aggregate("es", init, step)["misses"].alias("m"))
    flagged = folded.select("k", F.explode_outer(F.transform(
        "es", lambda e: F.struct(e["id"].alias("id"), e["ts"].alias("ts"),
                                 F.array_contains(F.col("m"), e["id"].cast("long")).alias("miss")))).alias("o"))
    return flagged.select(F.col("k").alias(key), F.col("o.id").alias(event_id), F.col("o.ts").alias(ts),
                          F.col("o.miss").alias("miss"))
