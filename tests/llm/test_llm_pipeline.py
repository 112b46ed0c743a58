"""The pipeline's stages: columns, decisions and empty tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from resemble.llm.decontaminate import find_benchmark, judged

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "source_mixing"]
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = out
        if name != "source_mixing":
            assert out.columns == docs.columns
    assert seen["language_id"].count() >= 195
    assert seen["line_dedup"].count() == seen["language_id"].count()
    lines = seen["line_dedup"].select(F.explode(F.split("text", "\n")).alias("l")).where("l <> ''")
    assert lines.count() == lines.distinct().count()
    assert seen["line_dedup"].where("n_chars <> length(text)").count() == 0
    found = judged(find_benchmark(seen["near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")))
    clean = {r[0] for r in found.where("not contaminated").select("doc_id").collect()}
    assert {r[0] for r in seen["benchmark_decontamination"].select("doc_id").collect()} == clean
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    total = seen["benchmark_decontamination"].agg(F.sum(words)).first()[0]
    mixed = seen["source_mixing"].agg(F.sum(words)).first()[0]
    assert abs(mixed - 1.5 * total) <= 20


def test_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "shard", "take"} <= set(out.columns)
