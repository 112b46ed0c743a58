"""Content tables for the batch job.

The batch job takes a tab-separated file with a header row and at least two
columns.  Every column is read as a string (the reference's inferred number
columns fail later, quirk Q11), blanks become ``''`` and the result is written
back as tab-separated text next to the input columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Accepted upload types and the minimum column count.
# ---------------------------------------------------------------------------
TEXT_TYPES = ("csv", "txt")
EXCEL_TYPES = ("xls", "xlsx")
MIN_COLUMNS = 2
# ---------------------------------------------------------------------------


def check_file_type(path: str) -> str:
    """Extension after the last dot, case-sensitive; Excel is not read (convert to TSV)."""
    name = os.path.basename(path)
    if "." not in name:
        raise ValueError("File type is not supported, supported file type is csv, txt, xls, xlsx")
    ext = name.rsplit(".", 1)[1]
    if ext in EXCEL_TYPES:
        raise ValueError("Excel files are not read; convert the upload to tab-separated text")
    if ext not in TEXT_TYPES:
        raise ValueError("File type is not supported, supported file type is csv, txt, xls, xlsx")
    return ext


def content_table(df: DataFrame, key: str | None = None) -> DataFrame:
    """S3: every column as a string, null → '' ; fewer than two content columns is an error."""
    content = [c for c in df.columns if c != key]
    if len(content) < MIN_COLUMNS:
        raise ValueError("File must contain at least %d fields" % MIN_COLUMNS)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != key else F.col(c)
                       for c in df.columns])


def read_content_table(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2 + S3: tab-separated, header row, UTF-8, all strings.

    A field in quotes may hold tabs, line feeds and quotes, which are doubled.
    So a record may span lines and a file is read by one task; a table of many
    part files is read in parallel.
    """
    check_file_type(path)
    return content_table(_tsv(spark.read, multiLine=True, inferSchema=False).csv(path))


def _tsv(io, **more):
    """Reader or writer of the dialect: tabs, quotes doubled, spaces kept, a header."""
    same = dict(sep="\t", header=True, encoding="UTF-8", quote='"', escape='"', lineSep="\n", nullValue="", emptyValue="",
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.options(**same, **more)


def write_result_table(df: DataFrame, out_dir: str) -> None:
    """Tab-separated with a header, UTF-8, one folder of part files; fields are quoted, quotes in them doubled."""
    _tsv(df.write.mode("overwrite"), quoteAll=True).csv(out_dir)


def result_name(upload_name: str, job_id: str) -> str:
    """``<name>_result-for-job_<id>.csv`` (the name without its extension)."""
    stem = os.path.splitext(os.path.basename(upload_name))[0]
    return "%s_result-for-job_%s.csv" % (stem, job_id)
