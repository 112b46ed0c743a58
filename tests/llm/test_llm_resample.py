"""Importance resampling against a plain computation, and its defined results."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from resemble.llm.resample import bucket_counts, drawn_documents, importance_resample, ranked
from resemble.llm.graph import stored

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, max_n):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ)) if x]
    return len(w), Counter(" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))


def brute(docs, target, percent, least, max_n, buckets, seed):
    def table(texts):
        c = Counter()
        for t in texts:
            for f, n in brute_features(t, max_n)[1].items():
                c[crc32(f.encode()) % buckets] += n
        return c

    s, t = table(x for _, x in docs), table(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n_words, f = brute_features(text, max_n)
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
                     for x, n in f.items() for b in [crc32(x.encode()) % buckets])
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        rows.append([i, n_words, sum(f.values()), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (3, 50, 40)])
def test_resampling_matches_brute_force(spark, max_n, buckets, percent):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs += [(9000, None), (9001, ""), (9002, "Ünï-Cødé   x_y 1,000 \x7f z" * 9), (None, "one two " * 15), (9003, "w " * 50_000)]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string").repartition(3)
    got = importance_resample(d, t, percent=percent, max_n=max_n, buckets=buckets)
    assert as_rows(got) == brute(docs, target, percent, 20, max_n, buckets, "2024")


def test_repeats_ties_and_clashing_columns(spark):
    docs = [(1, "a b c d " * 6)] * 5 + [(2, "a b c d " * 6), (3, "x y " * 20)]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([("a b",)], "text string")
    want = as_rows(importance_resample(plain, t, percent=60))
    assert [r[5] for r in want].count(None) == len(docs) - len(docs) * 60 // 100
    assert want == brute(docs, ["a b"], 60, 20, 1, 10_000, "2024")
    names = ("n_words", "n_features", "weight", "score", "rank", "bucket", "n", "_at", "_range", "_start")
    clash = plain.withColumns({c: F.lit("mine") for c in names})
    assert as_rows(importance_resample(clash, t, percent=60)) == want
    kept = drawn_documents(clash, t, percent=60)
    assert kept.columns == clash.columns and kept.where("score <> 'mine'").count() == 0
    # rows that equal the last one drawn in id and score all stay
    ids = sorted(r[0] for r in want if r[5] is not None)
    assert {r["doc_id"] for r in kept.collect()} == set(ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    t = spark.createDataFrame([("a b",)], "text string")
    assert importance_resample(none, t).count() == 0 and drawn_documents(none, t).count() == 0
    d = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert as_rows(importance_resample(d, none.select("text"), percent=100)) == brute([(1, "a " * 30)], [], 100, 20, 1, 10_000, "2024")


def test_counts_fold_at_any_number_of_keys(spark, monkeypatch):
    from resemble.llm import resample

    d = spark.createDataFrame([(" ".join(f"w{i % 37} v{i}" for i in range(3_000)),)] * 3, "text string")
    want = {tuple(r) for r in bucket_counts(d, 2, 101).collect()}
    monkeypatch.setattr(resample, "FOLD_KEYS", 3)
    assert {tuple(r) for r in bucket_counts(d, 2, 101).collect()} == want
    assert sum(n for _, n in want) == 3 * (6_000 + 5_999)


def test_ranks_of_many_equal_keys(spark):
    rows = stored(spark.range(5_000).select(F.lit(1).alias("s"), (F.col("id") % 7).alias("k")))
    got = ranked(rows, [F.col("s").desc(), F.col("k")], "r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1, 5_001))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)
