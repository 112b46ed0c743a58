"""URL lists, fetch responses and the crawl ledger.

The reference keeps fetched pages in a key-value cache with an expiry and
fetches only the URLs it does not hold.  Here the cache is a *ledger*: an
append-only table of page records ``(url, content, error, code, ok,
crawled_at)``, partitioned by crawl date on disk so that the expiry predicate
prunes partitions.  Every operation is a batch plan over it:

* ``resolve``  (S9, W1): latest record per requested URL newer than the expiry;
* ``frontier`` (J6, U2): requested URLs without such a record (``left_anti``);
* ``upsert``   (S11, S12, U4): ledger ∪ fresh records, latest per URL.

"Latest per URL" is ``max(struct(crawled_at, ...))`` grouped by URL: partial
aggregation map-side, so a URL requested a billion times is still one small
row per task before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resemble.session import materialize

# ---------------------------------------------------------------------------
# Default expiry and the fetch messages.
# ---------------------------------------------------------------------------
DEFAULT_TTL_SECONDS = 604_800
URL_STRIP_CHARS = " \t\n\r\x0b\x0c\"'"
MSG_EMPTY_URL = "url is empty"
MSG_TIMEOUT = "Web page read timeout"
MSG_PAGE_TIMEOUT = "Crawling error: pageTimeoutFlag=true"
MSG_CRAWL_ERROR = "Crawling error: "
TIMEOUT_CODE = 408
# ---------------------------------------------------------------------------

LEDGER_COLUMNS = ("url", "content", "error", "code", "ok", "crawled_at")


def parse_url_list(raw: Column) -> Column:
    """S6 + S7: comma string → array of URLs, each stripped of white space and both quotes, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.btrim(x, F.lit(URL_STRIP_CHARS)))
    return F.filter(parts, lambda x: x != "")


def request_urls(requests: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """S6 + A2: ``(id, url, pos)``, one row per distinct URL of a request, first position kept."""
    exploded = requests.select(id_col, F.posexplode(parse_url_list(F.col(raw_col))).alias("pos", "url"))
    return exploded.groupBy(id_col, "url").agg(F.min("pos").alias("pos"))


def normalise_responses(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw fetch responses → page records.

    ``responses``: ``url, status, ok, reason, html, page_timeout, exception,
    timed_out``.  Blank URL → ``url is empty`` (no code, no ok); a timeout →
    ``Web page read timeout``, 408; another exception → its message, 408; an
    ok response with the page-timeout flag → ``Crawling error:
    pageTimeoutFlag=true``; not ok → ``Crawling error: <reason>``;
    ``ok = response ok and no error``.  Columns named in ``keep`` pass through.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    blank = url == ""
    exc = F.col("exception").isNotNull() | F.coalesce(F.col("timed_out"), F.lit(False))
    resp_ok = F.coalesce(F.col("ok"), F.lit(False))
    error = (F.when(blank, F.lit(MSG_EMPTY_URL))
             .when(F.coalesce(F.col("timed_out"), F.lit(False)), F.lit(MSG_TIMEOUT))
             .when(F.col("exception").isNotNull(), F.col("exception"))
             .when(resp_ok & F.coalesce(F.col("page_timeout"), F.lit(False)), F.lit(MSG_PAGE_TIMEOUT))
             .when(~resp_ok, F.concat(F.lit(MSG_CRAWL_ERROR), F.coalesce(F.col("reason"), F.lit("")))))
    content = F.when(~blank & ~exc & resp_ok & ~F.coalesce(F.col("page_timeout"), F.lit(False)),
                     F.coalesce(F.col("html"), F.lit(""))).otherwise(F.lit(""))
    code = F.when(blank, F.lit(None).cast("int")).when(exc, F.lit(TIMEOUT_CODE)).otherwise(F.col("status").cast("int"))
    ok = F.when(blank, F.lit(None).cast("boolean")).when(exc, F.lit(False)).otherwise(resp_ok & error.isNull())
    return responses.select(*keep, url.alias("url"), content.alias("content"), error.alias("error"),
                            code.alias("code"), ok.alias("ok"))


#: a page record as it is kept: see ``encode_record``
RECORD_SCHEMA = "url string, content string, error string, code int, ok boolean"


def encode_record() -> Column:
    """A page record's columns as one JSON string; null members are written, so decoding restores them."""
    return F.to_json(F.struct("url", "content", "error", "code", "ok"), {"ignoreNullFields": "false"})


def decode_record(record: Column) -> Column:
    """The struct that ``encode_record`` wrote; null for a string that is no record."""
    return F.from_json(record, RECORD_SCHEMA)


def _at(asof: dt.datetime | str | Column) -> Column:
    """A moment as a timestamp: a value, or a column such as a scalar subquery."""
    return (asof if isinstance(asof, Column) else F.lit(asof)).cast("timestamp")


def stamp(records: DataFrame, asof: dt.datetime | str | Column) -> DataFrame:
    """Stamp fresh records with the crawl time (every record, errors included)."""
    return records.withColumn("crawled_at", _at(asof)).select(*LEDGER_COLUMNS)


def latest_per_url(ledger: DataFrame) -> DataFrame:
    """One record per URL, the newest (ties: the larger record, deterministic)."""
    rec = F.struct(F.col("crawled_at"), *[F.col(c) for c in LEDGER_COLUMNS if c not in ("url", "crawled_at")])
    return ledger.groupBy("url").agg(F.max(rec).alias("r")).select("url", "r.*").select(*LEDGER_COLUMNS)


def fresh_ledger(ledger: DataFrame, asof: dt.datetime | str | Column, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Ledger rows valid at ``asof``: ``asof − ttl < crawled_at ≤ asof`` (prunes date partitions)."""
    at = _at(asof)
    cutoff = at - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return ledger.where((F.col("crawled_at") > cutoff) & (F.col("crawled_at") <= at))


def resolve(requests: DataFrame, ledger: DataFrame, asof: dt.datetime | str | Column,
            ttl_seconds: int | None = DEFAULT_TTL_SECONDS) -> DataFrame:
    """S9 (S10 when ``ttl_seconds`` is None): cached records for the requested URLs.

    ``requests``: any frame with a ``url`` column.  Returns the whole latest
    record of each requested URL that has a valid one.
    """
    valid = ledger.where(F.col("crawled_at").isNotNull())
    if ttl_seconds is not None:
        valid = fresh_ledger(valid, asof, ttl_seconds)
    wanted = requests.select("url").distinct()
    return latest_per_url(valid.join(wanted, "url", "left_semi"))


def frontier(requests: DataFrame, ledger: DataFrame, asof: dt.datetime | str | Column,
             ttl_seconds: int | None = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Requested URLs that have no valid record, to be fetched."""
    valid = ledger.where(F.col("crawled_at").isNotNull())
    if ttl_seconds is not None:
        valid = fresh_ledger(valid, asof, ttl_seconds)
    # distinct first (partial aggregation): a URL crawled a billion times becomes one row
    # before the anti join, whose build side AQE could not split
    return requests.select("url").distinct().join(valid.select("url").distinct(), "url", "left_anti")


def upsert(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """The new snapshot: ledger ∪ fresh records, latest per URL."""
    return latest_per_url(ledger.select(*LEDGER_COLUMNS).unionByName(fresh.select(*LEDGER_COLUMNS)))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Append records to a ledger folder partitioned by crawl date."""
    ledger.withColumn("crawl_date", F.to_date("crawled_at")).write.mode("append") \
        .partitionBy("crawl_date").parquet(path)


# --- S12 / U4 on a stored snapshot: only the buckets that fresh records touch are rewritten ---

BUCKETS = 256


def _bucketed(records: DataFrame, buckets: int) -> DataFrame:
    return records.select(*LEDGER_COLUMNS, F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket"))


def _write_buckets(records: DataFrame, path: str, mode: str) -> None:
    # one task writes a bucket, so a bucket is one file; dynamic: buckets without rows here stay as they are
    records.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_snapshot(ledger: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The latest record of each URL, in folders by a hash of the URL.

    ``buckets`` belongs to the folder: every later upsert must name the same.
    """
    _write_buckets(_bucketed(latest_per_url(ledger), buckets), path, "error")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*LEDGER_COLUMNS)


def upsert_snapshot(path: str, fresh: DataFrame, buckets: int = BUCKETS) -> int:
    """Merge fresh records into a snapshot; returns how many of its buckets were rewritten.

    A URL's bucket is known from its hash, so the other buckets are neither read
    (the bucket list prunes their folders) nor written.  The merged rows are
    checkpointed before the folders they were read from are replaced; a job that
    is lost on the way leaves the old folders in place and can be run again.
    """
    spark = fresh.sparkSession
    new = materialize(_bucketed(latest_per_url(fresh), buckets))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # as many as buckets at most
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    merged = materialize(_bucketed(upsert(old, new), buckets))
    _write_buckets(merged, path, "overwrite")
    return len(touched)
