"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resemble.llm.chat import rotate
from resemble.llm.decontaminate import find_benchmark, judged
from resemble.llm.htmltext import extract_main_text
from resemble.llm.langid import address_suffix, declared_language, domain_of, fit_text_model, identify
from resemble.llm.linededup import dedup_lines
from resemble.llm.lmscore import lm_scores
from resemble.llm.mixing import mix_counts
from resemble.llm.neardup import near_groups
from resemble.llm.negatives import hard_negatives, quantised
from resemble.llm.resample import importance_resample
from resemble.llm.sketch import fingerprints
from resemble.llm.substrings import remove_repeats
from resemble.llm.urlfilter import judge_urls
from resemble.llm.urlparts import host_of
from resemble.sources.tables import read_table

#: fixed by the contract: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: a host is listed if a part of one of its labels, between dots and hyphens, is one of these words
LISTED_WORDS = ["adult", "bets", "casino", "pills", "poker", "porn", "spam", "xxx"]


def op1_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read_table(spark, sf_dir, "conversations", spread_text=False))


def op3_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*[F.lit(w) for w in LISTED_WORDS])))
    return judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their declaration, suffix, host and domain, and documents with their source as the host."""
    pages, docs = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    model = fit_text_model(docs)
    host = host_of(F.col("url"))
    of_pages = identify(pages, model, ["page_id"], "html", markup=True, declared=declared_language(F.col("html")),
                        suffix=address_suffix(host), levels=[domain_of(host), host])
    of_docs = identify(docs, model, ["doc_id"], "text", levels=[F.col("source")])
    return of_pages.unionByName(of_docs, allowMissingColumns=True)


def op5_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bwt_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents", spread_text=False).select("doc_id", "text"), with_bytes=False).drop("kept")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = near_groups(docs, width=3, percent=85)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(find_benchmark(docs, read_table(spark, sf_dir, "benchmark", spread_text=False)))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_resample(docs, target).drop("n_words")


def op12_bloom_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(vectors.withColumn("label", label)))


QUERIES = {
    "op6_bwt_substring_dedup": op6_bwt_substring_dedup,
    "op1_html_text_density": op1_html_text_density,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op5_threshold_sketch": op5_threshold_sketch,
    "op4_language_id": op4_language_id,
    "op3_url_bloom_cascade": op3_url_bloom_cascade,
    "op7_source_mixing": op7_source_mixing,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_bloom_lm_scoring": op12_bloom_lm_scoring,
    "op13_hard_negatives": op13_hard_negatives,
}
