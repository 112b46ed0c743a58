"""S1-S4 content tables, S10 lookup without expiry, V2 user extractors."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from resemble.operators import pages as P
from resemble.sources import content as C
from resemble.sources import ledger as L


def test_file_type_gate():
    assert C.check_file_type("a.csv") == "csv" and C.check_file_type("a.b.txt") == "txt"
    for bad in ("noext", "a.CSV", "a.json"):
        with pytest.raises(ValueError):
            C.check_file_type(bad)
    with pytest.raises(ValueError):
        C.check_file_type("sheet.xlsx")


def test_tsv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="resemble-test-")
    src = os.path.join(d, "upload.txt")
    with open(src, "w", encoding="utf-8") as f:
        f.write("content1\tcontent2\tn\nred blue\tred blue green\t7\n\tblue\t\n")
    df = C.read_content_table(spark, src)
    assert df.dtypes == [("content1", "string"), ("content2", "string"), ("n", "string")]
    rows = df.collect()
    assert rows[1].content1 == "" and rows[1].n == ""
    from resemble.operators.checks import pairwise_columns

    out = pairwise_columns(df.drop("n"), "cosine")
    target = os.path.join(d, C.result_name("upload.txt", "j1"))
    C.write_result_table(out, target)
    back = spark.read.option("sep", "\t").option("header", True).csv(target)
    assert back.columns == ["content1", "content2", "Distance-content1-content2"]
    assert C.result_name("x/upload.txt", "j1") == "upload_result-for-job_j1.csv"


def test_fewer_than_two_columns(spark):
    with pytest.raises(ValueError):
        C.content_table(spark.createDataFrame([("a",)], "only string"))


def test_s10_no_expiry(spark):
    ledger = spark.createDataFrame([("a", "x", None, 200, True, dt.datetime(2000, 1, 1)),
                                    ("b", "y", None, 200, True, None)],
                                   "url string, content string, error string, code int, ok boolean, crawled_at timestamp")
    req = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [r.url for r in L.resolve(req, ledger, "2024-01-01", ttl_seconds=None).collect()] == ["a"]


def test_user_extractor(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>Hi</p>")], "page_id long, url string, html string")
    P.register_extractor("upper", lambda pg, nodes: pg.select("page_id", "url", F.upper("html").alias("content")))
    assert P.extract(pages, "upper").first().content == "<P>HI</P>"


def test_s11_ledger_write_and_prune(spark):
    d = tempfile.mkdtemp(prefix="resemble-ledger-")
    now = dt.datetime(2024, 1, 31)
    recs = spark.createDataFrame([("a", "x", None, 200, True), ("b", "", "boom", 408, False)],
                                 "url string, content string, error string, code int, ok boolean")
    L.write_ledger(L.stamp(recs, now - dt.timedelta(days=10)), d)
    L.write_ledger(L.stamp(recs.where("url = 'a'"), now - dt.timedelta(days=1)), d)
    ledger = spark.read.parquet(d)
    assert sorted(r.crawl_date.isoformat() for r in ledger.select("crawl_date").distinct().collect()) == \
        ["2024-01-21", "2024-01-30"]
    req = spark.createDataFrame([("a",), ("b",)], "url string")
    hits = L.resolve(req, ledger.drop("crawl_date"), now)
    assert [r.url for r in hits.collect()] == ["a"]
    assert [r.url for r in L.frontier(req, ledger.drop("crawl_date"), now).collect()] == ["b"]


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    cols = "url string, content string, error string, code int, ok boolean, crawled_at timestamp"
    day = dt.datetime(2024, 1, 1)
    rows = [(f"http://u/{i}", f"old {i}", None, 200, True, day) for i in range(400)]
    path = str(tmp_path / "snapshot")
    L.write_snapshot(spark.createDataFrame([*rows, *rows[:50]], cols), path, 32)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    assert len(before) <= 32 and L.read_snapshot(spark, path).count() == 400
    fresh = [(rows[7][0], "new", None, 200, True, day + dt.timedelta(days=1)), ("http://u/added", "first", None, 200, True, day),
             (rows[9][0], "older", None, 200, True, day - dt.timedelta(days=1))]
    rewritten = L.upsert_snapshot(path, spark.createDataFrame(fresh, cols), 32)
    after = files()
    assert 1 <= rewritten <= 3 and len(set(before.items()) - set(after.items())) <= rewritten
    assert len(set(before.items()) & set(after.items())) >= len(before) - rewritten
    got = {r.url: r.content for r in L.read_snapshot(spark, path).collect()}
    want = {r.url: r.content for r in L.upsert(spark.createDataFrame(rows, cols), spark.createDataFrame(fresh, cols)).collect()}
    assert got == want and got[rows[7][0]] == "new" and got[rows[9][0]] == "old 9" and len(got) == 401
    assert L.upsert_snapshot(path, spark.createDataFrame([], cols), 32) == 0 and files() == after


@pytest.mark.parametrize("cells", [('say "hi"', "a\tb"), ("two\nlines", ' spaced "x" '), ("", "\\n \\"), ('"', '""'), ("é,ü;", "\r\n x\n\ny"), ("#no comment", "1")])
def test_quoted_fields_come_back_as_they_are(spark, tmp_path, cells):
    path = str(tmp_path / "result.csv")
    C.write_result_table(spark.createDataFrame([cells, ("p", "q")], "one string, two string"), path)
    assert sorted(map(tuple, C.read_content_table(spark, path).collect())) == sorted([cells, ("p", "q")])


def test_uploads_of_other_writers(spark, tmp_path):
    path = tmp_path / "upload.txt"
    path.write_text('content1\tcontent2\n"say ""hi"" now\tx"\ty\n"two\nlines"\tz\nplain "quote" inside\t\n', encoding="utf-8")
    got = [tuple(r) for r in C.read_content_table(spark, str(path)).collect()]
    assert got == [('say "hi" now\tx', "y"), ("two\nlines", "z"), ('plain "quote" inside', "")]
