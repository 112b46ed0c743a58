"""Similarity checks: one-vs-many, three-way, pairwise columns, content pairs.

J1 one-vs-many, J2 three-way cross check, J3 N-column pairwise within a row,
J4/J5 content pair/triple with several metrics (M5), with the error routing of
F1/F2/F4, the sort of W3 and the selector-group union of U5 (``pages.py``).

A *corpus* is any DataFrame ``(key, content, error)``: ``content`` is the text
to compare ('' when missing), ``error`` is null for a good page.  Documents
map to it directly; pages map to it after extraction.

Plan shape of :func:`one_vs_many`
---------------------------------
* Tokens and metric features are computed once per document (narrow).
* Sub side: ``checks ⋈ features`` on the sub key, a shuffle equi-join.
* Main side: when the distinct (check, main) rows are few (checked with a
  bounded count), the main keys go into an ``IN`` list that reaches the Parquet
  scan, the main features are built from that small read and, if their bytes are
  few, too, broadcast to the sub side, so the hot key "one main, all subs" never
  moves through a shuffle.  Otherwise
  a shuffle join on ``check_id`` with AQE skew splitting.
"""

from __future__ import annotations

from typing import Callable, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resemble.functions.metrics import (
    METRIC_NAMES,
    UNKNOWN_METRIC_MESSAGE,
    Metric,
    feature_columns,
    get_metric,
    known_metric,
    prepare_features,
)
from resemble.functions.tokens import clean_text, with_tokens
from resemble.operators.order import competition_rank, order_score
from resemble.session import broadcast_within, materialize

# ---------------------------------------------------------------------------
# The reference's result messages.
# ---------------------------------------------------------------------------
PAGE_NOT_FOUND = "Page not found"
MAIN_NOT_FOUND = "Main page not found"
MAIN_EMPTY = "Main page is empty"
PAIR_NAMES = ("12", "23", "13")
# ---------------------------------------------------------------------------

MAX_BROADCAST_MAINS = 256


def corpus_from(df: DataFrame, key: str, content: str, error: str | None = None) -> DataFrame:
    """Shape any table as a corpus ``(key, content, error)``."""
    err = F.col(error).cast("string") if error else F.lit(None).cast("string")
    return df.select(F.col(key).alias("key"), clean_text(F.col(content)).alias("content"), err.alias("error"))


def document_features(corpus: DataFrame, metrics: list[Metric], prefix: str, unit: str = "word",
                      min_ngram: int = 1, max_ngram: int = 1, stem: bool = True) -> DataFrame:
    """Per-document ``(key, error, empty, <features>)``, tokenised once."""
    base = corpus.select(F.col("key"), F.col("error"), (F.col("content") == "").alias("empty"), "content")
    toks = with_tokens(base, "content", "_tokens", unit, min_ngram, max_ngram, stem).drop("content")
    feats = prepare_features(toks, ["key"], "_tokens", prefix, metrics)
    cols = ["key", "error", "empty", *feature_columns(prefix, metrics)]
    return feats.select(*cols).select(
        *[F.col(c).alias(prefix + c) if c in ("key", "error", "empty") else F.col(c) for c in cols])


def _bounded_mains(checks: DataFrame, limit: int) -> list | None:
    """Main keys, if the distinct ``(check_id, main_key)`` rows (what gets broadcast) are at most ``limit``."""
    rows = checks.select("check_id", "main_key").distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted({r[1] for r in rows}, key=str)


CorpusSource = Union[DataFrame, Callable[[Union[DataFrame, list]], DataFrame]]


def _corpus(source: CorpusSource, keys: DataFrame | list) -> DataFrame:
    """A corpus restricted to ``keys``: a short list, or a distinct ``key`` column.

    A callable source gets the keys itself, so it can filter raw input before
    an expensive stage.  The semi join runs before anything is tokenised.
    """
    if callable(source):
        return source(keys)
    return source.where(F.col("key").isin(keys)) if isinstance(keys, list) else source.join(keys, "key", "left_semi")


def _keys(checks: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys that the checks name in ``columns``."""
    out = checks.select(F.explode(F.array(*columns)).alias("key")) if len(columns) > 1 else checks.select(F.col(columns[0]).alias("key"))
    return out.where(F.col("key").isNotNull()).distinct()


def one_vs_many(checks: DataFrame, corpus: CorpusSource, metric: str | None = "cosine", unit: str = "word",
                min_ngram: int = 1, max_ngram: int = 1, stem: bool = True, check_main_error: bool = True,
                sort: bool = True, max_broadcast_mains: int = MAX_BROADCAST_MAINS,
                main_corpus: CorpusSource | None = None) -> DataFrame:
    """Each check's main document against each of its distinct sub documents.

    ``checks``: ``(check_id, main_key, sub_key)``.  ``corpus`` is a corpus
    DataFrame or a builder ``keys -> corpus``; ``main_corpus`` (default: the
    same) serves the main side, e.g. pages extracted by another selector (U5).
    Returns ``(check_id, sub_key, similarity double, error string, rank int)``,
    sorted by W3: message rows first, then similarity descending, then key.
    """
    m = get_metric(metric)
    tok = dict(unit=unit, min_ngram=min_ngram, max_ngram=max_ngram, stem=stem)
    checks = checks.select("check_id", "main_key", "sub_key").dropDuplicates(["check_id", "main_key", "sub_key"])
    main_source = corpus if main_corpus is None else main_corpus

    sub_feats = document_features(_corpus(corpus, _keys(checks, "sub_key")), [m], "s_", **tok)
    # left: a requested sub page without a record is reported, not dropped
    subs = checks.join(sub_feats, checks.sub_key == sub_feats.s_key, "left")

    mains = checks.select("check_id", "main_key").distinct()
    keys = _bounded_mains(checks, max_broadcast_mains)
    if keys is not None:
        main_feats = document_features(_corpus(main_source, keys), [m], "m_", **tok)
        # few rows, but a main's features are as long as its text: their bytes decide
        main_side = materialize(F.broadcast(mains).join(main_feats, mains.main_key == main_feats.m_key, "left").drop("main_key"))
        pairs = subs.join(broadcast_within(main_side), on="check_id", how="inner")
    else:
        main_feats = document_features(_corpus(main_source, _keys(checks, "main_key")), [m], "m_", **tok)
        main_side = mains.join(main_feats, mains.main_key == main_feats.m_key, "left")
        pairs = subs.join(main_side.drop("main_key"), on="check_id", how="inner")

    error = F.when(F.col("m_key").isNull() | (F.col("m_error").isNotNull() if check_main_error else F.lit(False)),
                   F.lit(MAIN_NOT_FOUND)) \
        .when(F.col("m_empty"), F.lit(MAIN_EMPTY)) \
        .when(F.col("s_error").isNotNull() | F.col("s_key").isNull(), F.lit(PAGE_NOT_FOUND))
    out = pairs.select(
        "check_id",
        "sub_key",
        F.when(error.isNull(), m.compare("m_", "s_")).cast("double").alias("similarity"),
        error.alias("error"),
    )
    return rank_results(out, sort=sort, rounded=m.rounded)


def rank_results(df: DataFrame, sort: bool = True, key: str = "sub_key", rounded: bool = True) -> DataFrame:
    """Competition rank per check (messages first) and an optional global sort."""
    # the scores feed the histogram and the join back: compute them once
    scored = materialize(df.withColumn("_o", order_score(F.col("similarity"), F.col("error"))))
    ranked = competition_rank(scored, ["check_id"], "_o", rounded=rounded)
    if sort:
        ranked = ranked.orderBy(F.col("check_id"), F.col("_o").desc(), F.col(key))
    return ranked.drop("_o")


def _pair_error(left_err: Column, left_key: Column, right_err: Column, right_key: Column) -> Column:
    """left error first, then right: ``Page not found: <key>``."""
    return F.when(left_err.isNotNull(), F.concat(F.lit(PAGE_NOT_FOUND + ": "), left_key.cast("string"))) \
        .when(right_err.isNotNull(), F.concat(F.lit(PAGE_NOT_FOUND + ": "), right_key.cast("string")))


def cross_check(checks: DataFrame, corpus: CorpusSource, metric: str | None = "cosine", unit: str = "word",
                min_ngram: int = 1, max_ngram: int = 1, stem: bool = True) -> DataFrame:
    """Three keys per check, pairs 12, 23, 13 in that order.

    ``checks``: ``(check_id, key_1, key_2, key_3)``.  Long result
    ``(check_id, pair, left_key, right_key, similarity, error)``; use
    :func:`cross_check_wide` for ``sim12, sim23, sim13``.
    """
    m = get_metric(metric)
    tok = dict(unit=unit, min_ngram=min_ngram, max_ngram=max_ngram, stem=stem)
    pairs = checks.select(
        "check_id",
        F.explode(F.array(
            F.struct(F.lit("12").alias("pair"), F.col("key_1").alias("left_key"), F.col("key_2").alias("right_key")),
            F.struct(F.lit("23").alias("pair"), F.col("key_2").alias("left_key"), F.col("key_3").alias("right_key")),
            F.struct(F.lit("13").alias("pair"), F.col("key_1").alias("left_key"), F.col("key_3").alias("right_key")),
        )).alias("p"),
    ).select("check_id", "p.*")
    left = materialize(document_features(_corpus(corpus, _keys(checks, "key_1", "key_2", "key_3")), [m], "l_", **tok))  # both sides read it
    right = left.select(*[F.col(c).alias("r_" + c[2:]) for c in left.columns])
    joined = pairs.join(left, pairs.left_key == left.l_key, "left").join(right, pairs.right_key == right.r_key, "left")
    missing = F.lit("missing")
    error = _pair_error(F.coalesce(F.col("l_error"), F.when(F.col("l_key").isNull(), missing)), F.col("left_key"),
                        F.coalesce(F.col("r_error"), F.when(F.col("r_key").isNull(), missing)), F.col("right_key"))
    return joined.select(
        "check_id", "pair", "left_key", "right_key",
        F.when(error.isNull(), m.compare("l_", "r_")).cast("double").alias("similarity"),
        error.alias("error"),
    )


def cross_check_wide(long: DataFrame) -> DataFrame:
    """Pivot J2's long form to ``check_id, sim12, sim23, sim13`` (number or message as text)."""
    cell = F.coalesce(F.col("error"), F.col("similarity").cast("string"))
    return long.groupBy("check_id").pivot("pair", list(PAIR_NAMES)).agg(F.first(cell)) \
        .select("check_id", *[F.col(p).alias("sim" + p) for p in PAIR_NAMES])


def parse_metric_names(names: str | list[str] | None) -> list[str]:
    """M5: names lower-cased and stripped of ``space " '``; blank list = all four."""
    if names is None:
        return list(METRIC_NAMES)
    if isinstance(names, str):
        names = names.split(",")
    out = [n.strip(" \"'").lower() for n in names if n.strip(" \"'")]
    return out or list(METRIC_NAMES)


def _row_features(df: DataFrame, keys: list[str], text_col: str, prefix: str, metrics: list[Metric],
                  tok: dict) -> DataFrame:
    df = with_tokens(df, text_col, prefix + "tokens", **tok)
    return prepare_features(df, keys, prefix + "tokens", prefix, metrics)


def content_metrics(df: DataFrame, key: str, texts: list[str], metrics: str | list[str] | None = None,
                    unit: str = "word", min_ngram: int = 1, max_ngram: int = 1, stem: bool = True) -> DataFrame:
    """Row-wise texts, every column pair i<j, every chosen metric.

    Returns ``(key, pair, ord, metric, similarity, error)``: one row per pair and
    requested name, in request order (``ord``); an unknown name gives a row
    with the reference's message instead of a number.
    """
    names = parse_metric_names(metrics)
    known = [get_metric(n) for n in dict.fromkeys(n for n in names if known_metric(n))]
    tok = dict(unit=unit, min_ngram=min_ngram, max_ngram=max_ngram, stem=stem)
    cur = df.select(key, *texts)
    for i, t in enumerate(texts):
        cur = _row_features(cur, [key], t, f"c{i}_", known, tok)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    if len(texts) == 3:
        pairs = [(0, 1), (1, 2), (0, 2)]
    cells = []
    for i, j in pairs:
        for o, n in enumerate(names):
            if known_metric(n):
                sim, err = get_metric(n).compare(f"c{i}_", f"c{j}_").cast("double"), F.lit(None).cast("string")
            else:
                sim, err = F.lit(None).cast("double"), F.lit(UNKNOWN_METRIC_MESSAGE % n)
            cells.append(F.struct(F.lit(f"{i + 1}{j + 1}").alias("pair"), F.lit(o).alias("ord"),
                                  F.lit(n).alias("metric"), sim.alias("similarity"), err.alias("error")))
    return cur.select(key, F.explode_outer(F.array(*cells)).alias("c")).select(key, "c.*")


def distance_column_names(columns: list[str]) -> list[str]:
    """``Distance-<ci>-<cj>`` for every pair i<j, in that order."""
    return ["Distance-%s-%s" % (columns[i], columns[j])
            for i in range(len(columns)) for j in range(i + 1, len(columns))]


def pairwise_columns(table: DataFrame, metric: str | None = "cosine", unit: str = "word", min_ngram: int = 1,
                     max_ngram: int = 1, stem: bool = True, row_key: str | None = None) -> DataFrame:
    """The batch job. Every content column tokenised once, one distance column per pair.

    ``table``: string columns only (S1-S3); ``row_key`` names a column that is
    kept but not compared (needed by metrics that aggregate, e.g. simhash).
    """
    m = get_metric(metric)
    tok = dict(unit=unit, min_ngram=min_ngram, max_ngram=max_ngram, stem=stem)
    columns = [c for c in table.columns if c != row_key]
    cur = table
    keys = [row_key] if row_key else columns
    for i, c in enumerate(columns):
        cur = _row_features(cur, keys, c, f"c{i}_", [m], tok)
    names = distance_column_names(columns)
    dist = {}
    k = 0
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            dist[names[k]] = m.compare(f"c{i}_", f"c{j}_").cast("double")
            k += 1
    return cur.select(*table.columns, *[v.alias(n) for n, v in dist.items()])


def pairwise_cells(cells: DataFrame, row: str, column: str, content: str, metric: str | None = "cosine", unit: str = "word",
                   min_ngram: int = 1, max_ngram: int = 1, stem: bool = True) -> DataFrame:
    """J3 in long form: ``(row, left, right, similarity)`` for every two columns of the batch table, in each of its rows.

    ``cells`` holds one row a cell: the table's row, the column's number or name
    and the content.  The columns are those that occur in any row.  Cells of a row
    meet by an equi-join on the row.  A column that a row lacks counts as empty, so
    a pair with it has similarity 0: such pairs need no content and are listed from
    the row's numbers of cells a column, which meet the broadcast pairs of columns.
    Of a cell that occurs more than once each is compared with the cells of other
    columns.  A null row has no cells; a null column is none.
    """
    m = get_metric(metric)
    tok = dict(unit=unit, min_ngram=min_ngram, max_ngram=max_ngram, stem=stem)
    base = cells.select(F.col(row).alias("row"), F.col(column).alias("at"), F.col(content).alias("content"))
    toks = with_tokens(base, "content", "_tokens", **tok)
    feats = prepare_features(toks, ["row", "at"], "_tokens", "l_", [m]).select("row", "at", *feature_columns("l_", [m]))
    feats = materialize(feats)  # both sides read it
    right = feats.select("row", F.col("at").alias("right"), *[F.col(c).alias("r_" + c[2:]) for c in feature_columns("l_", [m])])
    met = feats.withColumnRenamed("at", "left").join(right, "row").where("left < right")
    met = met.select("row", "left", "right", m.compare("l_", "r_").cast("double").alias("similarity"))
    at = feats.where(F.col("at").isNotNull()).select("at").distinct()
    columns = at.withColumnRenamed("at", "left").join(at.withColumnRenamed("at", "right"), F.col("left") < F.col("right"))
    counts = feats.groupBy("row", "at").agg(F.count(F.lit(1)).alias("n"))
    held = F.collect_list(F.when(F.col("row").isNotNull() & F.col("at").isNotNull(), F.struct("at", "n")))
    rows = counts.groupBy("row").agg(F.map_from_entries(held).alias("held"))
    # few rows become many: without a number of its own the exchange would be joined into one task
    rows = rows.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    sides = rows.crossJoin(broadcast_within(columns)).withColumn("a", F.col("held")[F.col("left")]).withColumn("b", F.col("held")[F.col("right")])
    lacking = sides.where("a is null or b is null").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("a", "b", F.lit(1).cast("long")))))
    out = met.union(lacking.select("row", "left", "right", F.lit(0.0)))
    return out.select(F.col("row").alias(row), "left", "right", "similarity")
