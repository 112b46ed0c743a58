"""Connected components of an edge table, as joins and partial aggregations.

Alternating large-star and small-star rounds until all that is left are stars.
Each round is written to the shared checkpoint folder, so a lost executor
costs one round at most and the plan does not grow.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resemble.session import checkpoint_dir


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` computed once, written as a table to the shared checkpoint folder and read back; ``codec`` zstd for long texts."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` gave and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted: they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: rows of a stored table that may be broadcast: a few numbers each, so some tens of MB
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint where it is counted to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, and that one has none."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    inner = edges.join(edges.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi").select("a")
    return twice.union(inner).limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Null ends and loops are ignored; nodes without an edge to another node are not returned.
    A node of very many edges is safe: minima are pre-aggregated, and the joins
    stream the edge side, which adaptive execution splits.
    """
    cur = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _is_star(cur):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "x")
        # large star: a node's larger neighbours go to its smallest one
        large = both.join(low, F.col("a") == F.col("x")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
        joined = large.join(low, F.col("a") == F.col("x"))
        cur = stored(joined.select("a", F.col("m").alias("b"))
                     .union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
