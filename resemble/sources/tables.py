"""Table scans (S5) and the small-input spread rule.

A scan gets one task per Parquet split.  The test tables are single row
groups, so a 15 MB text table would be tokenised by one core.  ``spread``
hash-partitions such a scan by its key to the session's parallelism; on a
cluster, where a table of many files already yields far more splits than
cores, it is a no-op and adds no shuffle.  Hash partitioning on the key (not
round robin) also lets a later join or aggregation on that key reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition to the default parallelism only when the input has fewer partitions."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


# Key of each text table; these are spread when read.
TEXT_KEYS = {
    "documents": "doc_id",
    "pages": "page_id",
    "conversations": "conv_id",
    "benchmark": "item_id",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_text: bool = True) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; text tables are spread (see module doc)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_text and name in TEXT_KEYS:
        df = spread(df, TEXT_KEYS[name])
    return df
