"""Session construction and the shared checkpoint folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; :func:`checkpoint_dir` only reads it.  Where none is configured
(local tests and the bench) a folder in the session's warehouse is used, which
all executors share; never a machine's temporary folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    # text work is CPU-bound per row: let AQE coalesce small shuffles into
    # ~256 KB partitions (not 1 MB), so a few MB of candidate pairs still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
}


def build_session(master: str = "local[8]", app: str = "resemble", **conf: str) -> SparkSession:
    """Local session with the settings the package assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The configured ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    return ensure_checkpoint_dir(spark)


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the shared folder.

    Used for intermediates that several branches of one plan read (token sets,
    scored pairs, jump tables): without it each branch re-runs the tokeniser
    from the text.  The rows are persisted while the checkpoint is written, so
    they are computed once (a reliable checkpoint of an uncached Dataset
    computes it twice: once to count, once to save); the files sit under
    ``spark.checkpoint.dir``, the folder the cluster names, so a lost executor
    costs a re-read, not a recomputation.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


#: bytes of a table that may be broadcast
BROADCAST_BYTES = 64 << 20


def within_bytes(df, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a small, stored or cheap table take no more than ``most`` bytes, summed on the executors."""
    from pyspark.sql import functions as F

    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def broadcast_within(df, most: int = BROADCAST_BYTES):
    """A broadcast hint where the table's bytes are counted to be few; else the table as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if within_bytes(df, most) else df
