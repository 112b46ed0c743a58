"""Similarity metrics over two token arrays.

Each metric has two halves:

``prepare(df, tokens, prefix)``
    adds per-document features next to the tokens, once per document, before
    any pair is formed (a distinct set, a fingerprint, a sorted string);
``compare(left, right)``
    a Column over the features of two sides, evaluated per pair.

Pairs are therefore built from small features instead of raw token arrays,
and the per-document work is never repeated per pair.  Cosine, Jaccard and
simhash are native Spark expressions; fuzzy needs an LCS length, which runs in
a Python UDF (bit-parallel, Hyyrö 2004), row by row: its batches hold few texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Metric names in the reference's order, and its message text.
# ---------------------------------------------------------------------------
METRIC_NAMES = ("jaccard", "cosine", "fuzzy", "simhash")
DEFAULT_METRIC = "cosine"
UNKNOWN_METRIC_MESSAGE = "Distance metric %s do not existed, we support only jaccard, cosine, fuzzy, simhash"
# ---------------------------------------------------------------------------


# --- M1 / M2: binary vectors -------------------------------------------------

def cosine_of_sets(a: Column, b: Column) -> Column:
    """M1 on two distinct sets: round(|A∩B| / (sqrt|A|·sqrt|B|) · 100, 2); 0.0 if a side is empty."""
    na, nb = F.size(a), F.size(b)
    inter = F.size(F.array_intersect(a, b))
    value = F.round(inter / (F.sqrt(na) * F.sqrt(nb)) * 100, 2)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(value)


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """M2 on two distinct sets: round(|A∩B| / |A∪B| · 100, 2); 0.0 if both are empty."""
    na, nb = F.size(a), F.size(b)
    inter = F.size(F.array_intersect(a, b))
    union = na + nb - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(F.round(inter / union * 100, 2))


def cosine(a: Column, b: Column) -> Column:
    """M1 on token arrays (duplicates allowed)."""
    return cosine_of_sets(F.array_distinct(a), F.array_distinct(b))


def jaccard(a: Column, b: Column) -> Column:
    """M2 on token arrays (duplicates allowed)."""
    return jaccard_of_sets(F.array_distinct(a), F.array_distinct(b))


# --- A5 / M4: simhash -------------------------------------------------------

def token_hash64(token: Column) -> Column:
    """Low 64 bits of md5(token) as a signed long (two's complement).

    ``conv(.., 16, -10)`` keeps values above 2^63 representable under ANSI mode.
    """
    return F.conv(F.substring(F.md5(token), 17, 16), 16, -10).cast("long")


def with_fingerprint(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """A5: the 64-bit fingerprint of each row's token list (duplicates weigh more) as a new column.

    Bit i is set when the signed sum of bit i over all token hashes is > 0
    (Charikar 2002), that is when more than half of the hashes have it.
    Row-local: counters over the hashes, several in the lanes of a long, so nothing
    is exploded, shuffled or joined back.  The fewer the hashes, the narrower the
    lanes and the fewer passes over them.  An empty list gives 0.
    """
    # the hashes are a projection of their own: the counters refer to them, so they are computed once
    hashed = df.withColumn("_h", F.transform(tokens, token_hash64))
    found = _majority(LANES[-1])
    for lane in reversed(LANES[:-1]):
        found = f"if(size(_h) <= {(1 << (lane - 1)) - 2}, {_majority(lane)}, {found})"
    return hashed.withColumn(out, F.expr(found)).drop("_h")


#: bits of a lane; a lane of b bits counts up to 2 ** (b - 1) - 2 hashes
LANES = (8, 16, 32)


def _majority(lane: int) -> str:
    """SQL text of the bits that more than half of the hashes ``_h`` have, counted in lanes of so many bits.

    With ``2 ** (lane - 2) - 1 - number / 2`` added to every count, bit ``lane - 2`` of a lane is set exactly for those.
    """
    ones = sum(1 << k for k in range(0, 64, lane))
    add = f"({(1 << (lane - 2)) - 1}L - shiftright(cast(size(_h) as bigint), 1)) * {ones}L"
    sums = [f"aggregate(_h, {add}, (a, x) -> a + (shiftrightunsigned(x, {j}) & {ones}L))" for j in range(lane)]
    return " | ".join(f"shiftleft(shiftrightunsigned({c}, {lane - 2}) & {ones}L, {j})" for j, c in enumerate(sums))


def simhash_fingerprints(df: DataFrame, keys: list[str], tokens: str, out: str = "fingerprint") -> DataFrame:
    """A5: the keys, the fingerprint of their token list and its length (``out_n``)."""
    return with_fingerprint(df, tokens, out).select(*keys, out, F.size(tokens).cast("long").alias(out + "_n"))


def simhash_compare(fp_a: Column, n_a: Column, fp_b: Column, n_b: Column) -> Column:
    """M4: 100 − Hamming distance; 0 when either token list is empty."""
    return F.when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(
        (F.lit(100) - F.bit_count(fp_a.bitwiseXOR(fp_b))).cast("double"))


# --- M3: fuzzy (token sort ratio) -------------------------------------------

def fuzzy_prepare(tokens: Column) -> Column:
    """The processed, sorted string of token_sort_ratio.

    Tokens joined by a space; non-ASCII dropped; every char outside
    ``[A-Za-z0-9_]`` → space; lower; words sorted by code point; joined by one space.
    """
    s = F.array_join(tokens, " ")
    s = F.regexp_replace(s, r"[^\x00-\x7F]", "")
    s = F.lower(F.trim(F.regexp_replace(s, r"[^A-Za-z0-9_]", " ")))
    return F.array_join(F.array_sort(F.array_remove(F.split(s, " +"), "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks = _places(a)
    full = (1 << len(a)) - 1
    v = full
    for part in range(0, len(b), KEPT_STEPS):
        for ch in b[part:part + KEPT_STEPS]:
            u = v & masks[ch] if ch in masks else 0
            if u:
                v = (v + u) | (v ^ u)
        # a carry out of the highest bit reaches no lower one, so it may wait
        v &= full
    return len(a) - v.bit_count()


#: steps between two cuts to the string's own bits
KEPT_STEPS = 64


def _places(a: str) -> dict[str, int]:
    """For each character the number whose bit i tells whether it is at place i."""
    back = a[::-1]
    marks = dict.fromkeys(map(ord, set(a)), "0")
    return {ch: int(back.translate({**marks, ord(ch): "1"}), 2) for ch in set(a)}


def fuzzy_ratio(a: str, b: str) -> int:
    """round(100 · 2·LCS / (len a + len b)), half away from zero; 0 if a side is empty."""
    if not a or not b:
        return 0
    if a == b:
        return 100
    r = 2.0 * lcs_length(a, b) / (len(a) + len(b))
    x = 100.0 * r
    return int(x + 0.5)


@F.udf(T.DoubleType(), useArrow=False)
def fuzzy_ratio_udf(a: str | None, b: str | None) -> float:
    return float(fuzzy_ratio(a or "", b or ""))


# --- registry (M5, M6, V1) --------------------------------------------------

@dataclass(frozen=True)
class Metric:
    """A pluggable metric: per-document features plus a pairwise Column."""

    name: str
    prepare: Callable[[DataFrame, list[str], str, str], DataFrame]
    compare: Callable[[str, str], Column]
    feature_names: tuple[str, ...]
    #: whether scores are rounded, so that they take few values
    rounded: bool = True


def prepare_set(df: DataFrame, keys: list[str], tokens: str, prefix: str) -> DataFrame:
    """The distinct tokens as 64-bit hashes: they move, sort and intersect as longs."""
    return df.withColumn(prefix + "set", F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def _prepare_fuzzy(df: DataFrame, keys: list[str], tokens: str, prefix: str) -> DataFrame:
    return df.withColumn(prefix + "sorted", fuzzy_prepare(F.col(tokens)))


def _prepare_simhash(df: DataFrame, keys: list[str], tokens: str, prefix: str) -> DataFrame:
    return with_fingerprint(df, tokens, prefix + "fp").withColumn(prefix + "n", F.size(F.col(tokens)))


_REGISTRY: dict[str, Metric] = {}


def register_metric(metric: Metric) -> None:
    """M6 / V1: add or replace a metric by name."""
    _REGISTRY[metric.name] = metric


def get_metric(name: str | None) -> Metric:
    """blank → cosine; unknown → ValueError (raised while the plan is built)."""
    key = (name or "").strip().lower() or DEFAULT_METRIC
    if key not in _REGISTRY:
        raise ValueError("distance_metric must be in %s" % ", ".join(METRIC_NAMES))
    return _REGISTRY[key]


def known_metric(name: str) -> bool:
    return name in _REGISTRY


register_metric(Metric("cosine", prepare_set,
                       lambda l, r: cosine_of_sets(F.col(l + "set"), F.col(r + "set")), ("set",)))
register_metric(Metric("jaccard", prepare_set,
                       lambda l, r: jaccard_of_sets(F.col(l + "set"), F.col(r + "set")), ("set",)))
register_metric(Metric("simhash", _prepare_simhash,
                       lambda l, r: simhash_compare(F.col(l + "fp"), F.col(l + "n"), F.col(r + "fp"), F.col(r + "n")),
                       ("fp", "n")))
register_metric(Metric("fuzzy", _prepare_fuzzy,
                       lambda l, r: fuzzy_ratio_udf(F.col(l + "sorted"), F.col(r + "sorted")), ("sorted",)))


def prepare_features(df: DataFrame, keys: list[str], tokens: str, prefix: str,
                     metrics: list[Metric]) -> DataFrame:
    """Add the features of every metric in ``metrics`` (each kind once)."""
    done: set[str] = set()
    for m in metrics:
        if set(m.feature_names) <= done:
            continue
        df = m.prepare(df, keys, tokens, prefix)
        done |= set(m.feature_names)
    return df


def feature_columns(prefix: str, metrics: list[Metric]) -> list[str]:
    out: list[str] = []
    for m in metrics:
        for f in m.feature_names:
            if prefix + f not in out:
                out.append(prefix + f)
    return out
