"""Language ID by Bayesian fusion of text, declared markup language, address suffix and host priors.

The posterior of a language is proportional to

    prior(language | host) * P(text | language)^TEMPER * P(declared | language) * P(suffix | language)

*   P(text | language) is a multinomial model of byte trigrams (hashed to
    ``BUCKETS``), fitted on about ``train_rows`` labelled documents taken by a
    hash of their id, and on some ``LABEL_ROWS`` of each label at least (all, if
    it has fewer).  It is the only part that is fitted on a sample; which
    languages there are is told by all rows.
    Trigrams overlap three times, hence ``TEMPER``.
*   P(declared | language) and P(suffix | language) are counted over all rows,
    each row counting with its text posterior (expected counts), add-one smoothed.
*   prior(language | host) is smoothed along the levels: the host's expected
    counts with ``STRENGTH`` times its domain's prior, that one's with the
    corpus's.  Counts come from grouped aggregation; a row's own counts are
    left out of its host's and domain's.

Expected counts are sums of whole thousandths, so they do not depend on the
order of addition.  A row is rejected (language null) if its text has no
trigram with two letters, if a uniform draw of trigrams explains it better
than every language, or if no posterior reaches ``min_posterior``.

Defined results: null or empty text is rejected; a missing declaration,
suffix or host is evidence of its own value ''; ties go to the first language
by name; repeated rows get equal results; no labelled row: every row is
rejected; columns named like added ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resemble.llm.graph import small, stored
from resemble.llm.wordhash import text_slices

BUCKETS = 1 << 16
TRAIN_ROWS = 4_000
#: rows of a label that the sample has on average at least, or all if there are fewer
LABEL_ROWS = 100
TEMPER = 1 / 3
STRENGTH = 20.0
MIN_POSTERIOR = 0.5
MAX_LANGUAGES = 500
SLICE_BYTES = 256 << 10  # the arrays of a slice stay in a core's cache

_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;?"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)


def _clean(column: pa.Array, markup: bool) -> pa.Array:
    col = column.cast(pa.large_string()).fill_null("")
    if markup:
        col = pc.replace_substring_regex(col, pattern=_MARKUP, replacement=" ")
    return pc.utf8_lower(col)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams with two letters or more, and the bounds of each text's."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = _FOLD[data]
    letters = _LETTER[data].astype(np.int8)
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    use = letters[:-2] + letters[1:-1] + letters[2:] >= 2
    # a trigram that begins in a text's last two bytes would reach into the next one
    last = np.concatenate([offsets[1:] - 1, offsets[1:] - 2])
    use[last[(last >= 0) & (last < len(use))]] = False
    at = np.flatnonzero(use)
    buckets = ((gram[at] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return buckets, np.searchsorted(at, offsets)


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                   train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket; at most ``BUCKETS`` rows a language reach the driver."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("t"), F.xxhash64(F.lit("train"), id_col).alias("h"))
    # the languages are those of all rows
    kinds = [(r["label"], r["n"]) for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()]
    names = sorted(label for label, _ in kinds)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: is {label_col} a language?")
    total = sum(n for _, n in kinds)
    sample = labelled
    if total > train_rows:
        # the hash's place between 0 and 1 is below the wanted share; a rare label's share is larger, up to all its rows
        shares = [(label, math.ceil(1_000_003 * min(1.0, LABEL_ROWS / n)) if n * train_rows < LABEL_ROWS * total
                   else math.floor(1_000_003 * train_rows / total)) for label, n in kinds]
        share = F.broadcast(docs.sparkSession.createDataFrame(shares, "label string, share long"))
        sample = labelled.join(share, "label").where(F.pmod("h", F.lit(1_000_003)) < F.col("share"))

    def count(batches):
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in text_slices(_clean(batch.column(1), False), SLICE_BYTES):
                buckets, bounds = _trigrams(data, offsets)
                mine = np.repeat(labels[lo:hi], np.diff(bounds))
                for name in set(labels[lo:hi]):
                    n = np.bincount(buckets[mine == name], minlength=BUCKETS)
                    full = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(n[full])],
                                                     names=["label", "bucket", "n"])

    counts = (sample.select("label", "t").mapInArrow(count, "label string, bucket long, n long")
              .groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    table = np.ones((len(names), BUCKETS))
    found = counts.toArrow()
    if len(names):
        row = np.searchsorted(np.array(names, object), np.array(found.column("label").to_pylist(), object))
        table[row, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _rows_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], key_cols: list[str], text_col: str, markup: bool = False,
             declared: Column | None = None, suffix: Column | None = None, levels: list[Column] | None = None,
             min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``key_cols``, ``language`` (null: rejected), ``posterior``, ``text_language`` and ``n_trigrams`` per row.

    ``levels`` are the host's and its parents' names, from the widest to the narrowest.
    """
    names, logs = model
    spark = rows.sparkSession
    if not names:
        return rows.select(*key_cols, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"))
    n = len(names)
    blank = F.lit("")
    levels = [F.coalesce(c.cast("string"), blank) for c in (levels or [])]
    source = rows.select(*key_cols, F.coalesce(declared if declared is not None else blank, blank).alias("_declared"),
                         F.coalesce(suffix if suffix is not None else blank, blank).alias("_suffix"),
                         *[F.concat_ws("\t", *levels[:i + 1]).alias(f"_level{i}") for i in range(len(levels))],
                         F.col(text_col).cast("string").alias("_text"))
    shared = spark.sparkContext.broadcast(logs)
    carried = [f for f in source.schema.fields if f.name != "_text"]
    schema = T.StructType(carried + [T.StructField("n_trigrams", T.LongType()), T.StructField("_ll", T.ArrayType(T.DoubleType())),
                                     T.StructField("_w", T.ArrayType(T.LongType()))])

    def score(batches):
        table = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(_clean(batch.column(batch.num_columns - 1), markup), SLICE_BYTES):
                buckets, bounds = _trigrams(data, offsets)
                out = np.zeros((hi - lo, len(table)))
                full = np.diff(bounds) > 0
                for k in range(len(table)):
                    if full.any():
                        out[full, k] = np.add.reduceat(table[k][buckets], bounds[:-1][full], dtype=np.float64)
                # the row's weight for each language, in thousandths
                weight = np.rint(_softmax(out * TEMPER) * 1000).astype(np.int64) * full[:, None]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in batch.columns[:-1]] + [pa.array(np.diff(bounds)), _lists(out), _lists(weight)],
                    names=[f.name for f in schema])

    scored = stored(source.mapInArrow(score, schema))

    def counts(key: str | None) -> DataFrame:
        grouped = scored.groupBy(key) if key else scored.groupBy()
        return grouped.agg(F.array(*[F.coalesce(F.sum(F.col("_w")[i]), F.lit(0)) for i in range(n)]).alias("_c"))

    # corpus, declarations and suffixes: one row a value
    whole = counts(None).first()[0]
    corpus = [(c + 1000.0) / (sum(whole) + 1000.0 * n) for c in whole]
    out, likelihoods, parents = scored, [], []
    for col in ("_declared", "_suffix"):
        values = counts(col).withColumnRenamed(col, f"{col}_v")
        kinds = values.count()
        like = F.array(*[F.log((F.col("_c")[i] / 1000.0 + 1.0) / (whole[i] / 1000.0 + kinds)) for i in range(n)])
        out = out.join(values.select(f"{col}_v", like.alias(f"{col}_l")), F.col(col) == F.col(f"{col}_v"))
        likelihoods.append(f"{col}_l")
    for i in range(len(levels)):
        level = f"_level{i}"
        out = out.join(counts(level).withColumnsRenamed({level: f"{level}_v", "_c": f"{level}_c"}), F.col(level) == F.col(f"{level}_v"))
        parents.append(f"{level}_c")
    out = out.select(*key_cols, "n_trigrams", "_ll", "_w", *likelihoods, *parents)
    keys = len(key_cols)
    result = T.StructType([out.schema[c] for c in key_cols] + [
        T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()),
        T.StructField("text_language", T.StringType()), T.StructField("n_trigrams", T.LongType())])

    def fuse(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(keys).to_numpy()
            ll, own, *rest = [_rows_of(c, n) for c in batch.columns[keys + 1:]]
            prior = np.tile(np.array(corpus), (batch.num_rows, 1))
            for c in rest[len(likelihoods):]:
                # the row's own weight is left out of its host's and its parents' counts
                prior = (c - own) / 1000.0 + STRENGTH * prior
                prior /= prior.sum(axis=1, keepdims=True)
            p = _softmax(np.log(prior) + ll * TEMPER + sum(rest[:len(likelihoods)]))
            foreign = ll.max(axis=1) < number * math.log(1 / BUCKETS)
            known = (number > 0) & ~foreign & (p.max(axis=1) >= min_posterior)
            label = np.array(names, object)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:keys] + [pa.array(label[p.argmax(axis=1)], pa.string(), mask=~known), pa.array(p.max(axis=1)),
                                        pa.array(label[ll.argmax(axis=1)], pa.string(), mask=number == 0), batch.column(keys)],
                names=[f.name for f in result])

    return out.mapInArrow(fuse, result)


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1))


def address_suffix(host: Column) -> Column:
    """The host's last label."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The host's last two labels."""
    return F.substring_index(host, ".", -2)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                    host_col: str = "source") -> DataFrame:
    """``docs`` without those whose language is rejected; the source stands for the host."""
    keyed = docs.withColumn("_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    model = fit_text_model(docs, id_col, text_col, label_col)
    found = identify(keyed, model, [id_col, "_th"], text_col, levels=[F.col(host_col)])
    gone = stored(found.where("language is null").select(F.col(id_col).alias("_id"), F.col("_th").alias("_t")).distinct())
    left = keyed.join(small(gone), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")), "left_anti")
    return left.select(*[f"`{c}`" for c in docs.columns])
