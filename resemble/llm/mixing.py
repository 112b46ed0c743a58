"""Mixing sources to target weights by a splitting tree over source blocks.

1.  Sources get targets in words: weights share ``share`` times all words; a
    target stops at ``most`` times its source's words and the excess is shared
    by weight among the rest until none is above (``source_targets``).
2.  A source's documents are dealt into blocks by hash.  Its target is so many
    whole passes over all blocks, then blocks in permuted order up to the
    target.  One block a source is cut: its documents count in hash order, and
    the document at the cut gives its first words only.  So a source's words
    meet its target exactly, and a pass never takes a document twice.
3.  The splitting tree deals each source's block quota to the output shards:
    at every node a uniformly drawn half of all units goes left, which splits
    the quotas of all sources by a multivariate hypergeometric draw.
4.  Each shard draws that many of the source's permuted blocks, disjoint from
    the other shards', and its rows are shuffled locally.

Everything is native DataFrame work.  The tree sees blocks only: at most
``MAX_BLOCKS`` a source and pass, whatever the number of documents.  Hashes
with a fixed seed replace random numbers, so reruns agree.

Defined results: null text has no words; a null source is a source of its own,
last in order; documents without words are never taken; repeated rows (same
id and text) are taken alike; an empty table gives an empty table; input
columns named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resemble.llm.graph import small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20_240
BLOCK_DOCS = 64
MAX_BLOCKS = 1_024
SHARDS = 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """Adds size, source key (never null) and a hash of the row; the hash deals rows into blocks and orders them."""
    return docs.withColumns({
        "_size": n_words(F.col(text_col)),
        "_src": F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))),
        "_h": F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))),
    })


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (_src, words, ...) with ``target``.

    Capping and sharing again until none is above ends at ``least(cap, level * weight)``
    for one level; sources reach their cap in order of cap / weight, so running
    sums in that order give the level.  One row a source: the windows are small.
    """
    by_name, by_ratio = Window.orderBy("_src"), Window.orderBy("_ratio", "_src")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_w", F.element_at(table, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("_cap", F.col("words") * float(most)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    ranked = ranked.withColumns({
        "_left": F.sum("words").over(every) * float(share) - F.coalesce(F.sum("_cap").over(before), zero),
        "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), zero),
    }).withColumn("_capped", F.col("_ratio") * F.col("_rest") <= F.col("_left"))
    # the first source below its cap sees the level
    ranked = ranked.withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_src", (F.col("_left") / F.col("_rest")).alias("v")))).over(every)["v"])
    return ranked.withColumn(
        "target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    ).drop("_w", "_cap", "_ratio", "_left", "_rest", "_capped", "_level")


def _split_units(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(_src, _unit)`` rows with the shard that the splitting tree gives each; ``shards`` is a power of two."""
    out = units.withColumn("_node", F.lit(0))
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("_node")
        draw = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed + 1 + level), "_src", "_unit"), "_src", "_unit"))
        half = F.ceil(F.count(F.lit(1)).over(node) / 2)
        out = out.withColumn("_node", F.col("_node") * 2 + F.when(draw <= half, 0).otherwise(1))
    return out.withColumnRenamed("_node", "shard")


def mix_plan(rows: DataFrame, id_col: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
             shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``(id, _src, _size, _h)`` rows: the source, block and cut-document tables of the mix."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError(f"shards must be a power of two, not {shards}")
    sources = rows.groupBy("_src").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("_n"))
    sources = source_targets(sources, weights, share, most)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    sources = stored(sources.select(
        "_src", F.col("words").alias("source_size"), "target",
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("_n") / BLOCK_DOCS))).cast("int").alias("_blocks"),
        F.when(F.col("words") > 0, F.floor(quota / F.col("words"))).otherwise(0).cast("long").alias("_full"),
        F.when(F.col("words") > 0, quota % F.col("words")).otherwise(0).cast("long").alias("_rest")))
    blocks = placed(rows, sources).groupBy("_src", "_block").agg(F.sum("_size").alias("_words"))
    blocks = blocks.where("_words > 0").join(small(sources), "_src")
    order = Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed), "_src", "_block"), "_block")
    blocks = blocks.withColumn("_before", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_words"))
    # words of the pass after the whole ones that this block may give
    blocks = blocks.withColumn("_give", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_before"))))
    passes = F.col("_full") + F.when(F.col("_give") > 0, 1).otherwise(0)
    items = (blocks.where(passes > 0)
             .select("_src", "_block", F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias("_pass")))
    drawn = Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed), "_src", "_pass", "_block"), "_pass", "_block")
    items = stored(items.withColumn("_unit", F.row_number().over(drawn)))
    dealt = _split_units(items.select("_src", "_unit"), shards, seed)
    # a shard's quota of a source is a run of the source's permuted blocks
    dealt = dealt.select("_src", "shard", F.row_number().over(Window.partitionBy("_src").orderBy("shard", "_unit")).alias("_unit"))
    takes = items.join(dealt, ["_src", "_unit"]).groupBy("_src", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_pass", "shard"))).alias("_takes"))
    plan = stored(blocks.join(takes, ["_src", "_block"], "left").select(
        "_src", "_block", "_takes", F.col("_give").alias("_give"), (F.col("_give") < F.col("_words")).alias("_cut")))
    cut = plan.where("_cut and _give > 0").select("_src", "_block", "_give")
    near = placed(rows, sources).join(small(cut), ["_src", "_block"])
    near = near.groupBy("_src", "_block", "_give", "_h", id_col).agg(F.min("_size").alias("_size"), F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy("_src", "_block").orderBy("_h", id_col)
    taken_before = F.sum(F.col("_size") * F.col("_c")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size") * F.col("_c")
    near = near.withColumn("_part", F.greatest(F.lit(0), F.least(
        F.col("_size"), F.floor((F.col("_give") - taken_before) / F.col("_c")))).cast("long"))
    cut_docs = stored(near.select("_src", "_block", "_h", F.col(id_col).alias("_cut_id"), "_part"))
    return sources, plan, cut_docs


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their block."""
    return rows.join(small(sources.select("_src", "_blocks")), "_src").withColumn(
        "_block", F.pmod(F.shiftrightunsigned("_h", 16), F.col("_blocks")).cast("int"))


def _apply(rows: DataFrame, id_col: str, plan: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``takes`` (pass, shard, words of each taking)."""
    sources, blocks, cut_docs = plan
    out = placed(rows, sources).join(small(sources.select("_src", "source_size", "target", "_full")), "_src")
    out = out.join(small(blocks), ["_src", "_block"], "left")
    cut = cut_docs.withColumnsRenamed({"_src": "_s", "_block": "_b", "_h": "_hh"})
    out = out.join(small(cut), (F.col("_src") == F.col("_s")) & (F.col("_block") == F.col("_b"))
                   & (F.col("_h") == F.col("_hh")) & F.col(id_col).eqNullSafe(F.col("_cut_id")), "left")
    last = F.when(F.col("_cut"), F.coalesce("_part", F.lit(0))).otherwise(F.col("_size"))
    takes = F.transform(F.coalesce("_takes", F.array().cast("array<struct<_pass:bigint,shard:int>>")), lambda t: F.struct(
        t["_pass"].alias("pass"), t["shard"].alias("shard"),
        F.when(t["_pass"] <= F.col("_full"), F.col("_size")).otherwise(last).cast("long").alias("words")))
    return out.withColumn("takes", F.filter(takes, lambda t: t["words"] > 0))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken (words, repeats counted) and takes."""
    seed = options.get("seed", SEED)
    rows = stored(_keyed(docs, id_col, source_col, text_col, seed).select(id_col, "_src", "_size", "_h"))
    out = _apply(rows, id_col, mix_plan(rows, id_col, **options))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return out.select(id_col, F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "takes")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix: a row for each taking, with the document's columns, ``take``, ``shard`` and ``shuffle_key``.

    A taking of fewer words than the document has keeps its first words, joined
    by one space.  Rows are dealt out by shard and key and sorted by the key in
    each part, so that a shard's rows come in shuffled order.
    """
    seed = options.get("seed", SEED)
    keyed = _keyed(docs, id_col, source_col, text_col, seed)
    rows = stored(keyed.select(id_col, "_src", "_size", "_h"))
    mixed = _apply(keyed, id_col, mix_plan(rows, id_col, **options))
    mixed = mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("take", "shard", "shuffle_key")],
                         "_size", "_h", F.explode("takes").alias("_t"))
    words = F.array_remove(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), "")
    text = F.when(F.col("_t.words") < F.col("_size"), F.array_join(F.slice(words, F.lit(1), F.col("_t.words").cast("int")), " ")).otherwise(F.col(text_col))
    mixed = mixed.withColumn(text_col, text).withColumns({
        "take": F.col("_t.pass").cast("int"), "shard": F.col("_t.shard"),
        "shuffle_key": F.xxhash64(F.lit(seed + 99), "_h", "_t.pass")})
    mixed = mixed.drop("_size", "_h", "_t")
    return mixed.repartition("shard", F.pmod("shuffle_key", F.lit(64))).sortWithinPartitions("shard", "shuffle_key")
