"""URL filter: rules by host and path, and a Bloom filter cascade of listed hosts.

The cascade answers membership exactly for every key of a known universe:
level 1 encodes the listed keys; level 2 the keys of the universe that level 1
wrongly passes; level 3 the listed keys that level 2 wrongly passes; and so on
until nothing is wrongly passed.  A key is listed if the first level that
stops it is an even one (or none does and the number of levels is odd).

Levels are built by grouped aggregation over distinct keys: each key sets a few
bits, bits are gathered per 64-bit word, and a level becomes one binary
literal.  Its size follows from the number of encoded keys, which is counted
before.  So judging the urls needs neither a join nor a shuffle.  A list of
more than ``MAX_KEYS`` keys would make literals without a bound; it is joined
with the urls instead, with the same result.

Everything is native.  Defined results: a null url, or one without ``://``,
has an empty host and path; an empty list makes no level and lists nothing;
rows keep their number; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resemble.llm.graph import stored
from resemble.llm.urlparts import host_of, path_of

#: keys of one cascade; about 1.3 MB of bits in its first level at one false positive in 1,000
MAX_KEYS = 1_000_000
FIRST_RATE, NEXT_RATE = 0.001, 0.5
MAX_LEVELS = 64


def _shape(n_keys: int, rate: float) -> tuple[int, int]:
    """Words of 64 bits and number of hashes for ``n_keys`` at a false-positive rate."""
    bits = max(64, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2))
    words = math.ceil(bits / 64)
    return words, max(1, round(words * 64 / max(n_keys, 1) * math.log(2))) if n_keys else 1


def _bit(key: Column, level: int, i: int, words) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(words) * 64)


def _filter_bits(keys: DataFrame, level: int, words: int, hashes: int) -> bytes:
    """The level's bits; at most one row a 64-bit word reaches the driver, whatever the number of urls."""
    bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, words) for i in range(hashes)])).alias("bit"))
    rows = (bits.groupBy(F.shiftright("bit", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("b")).collect())
    out = bytearray(words * 8)
    for r in rows:
        out[r["w"] * 8:r["w"] * 8 + 8] = (r["b"] & ((1 << 64) - 1)).to_bytes(8, "little")
    return bytes(out)


def _passes(key: Column, level: int, bits: bytes, hashes: int) -> Column:
    """Whether all of the key's bits are set; ``bits`` is one binary literal, read a byte at a time."""
    test = F.lit(True)
    for i in range(hashes):
        bit = _bit(key, level, i, len(bits) // 8)
        byte = F.conv(F.hex(F.substring(F.lit(bits), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        test = test & (F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return test


class Cascade:
    """The levels of one list over one universe of keys."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """``universe`` and ``listed``: distinct non-null ``key`` columns; listed keys outside the universe may be there."""
        self.levels: list[tuple[bytes, int]] = []
        inside = stored(listed.select("key"))
        outside = stored(universe.select("key").join(inside, "key", "left_anti"))
        count = inside.count()
        while count:
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("the cascade does not end: are the keys distinct?")
            words, hashes = _shape(count, NEXT_RATE if self.levels else FIRST_RATE)
            bits = _filter_bits(inside, len(self.levels), words, hashes)
            passed = stored(outside.where(_passes(F.col("key"), len(self.levels), bits, hashes)))
            self.levels.append((bits, hashes))
            inside, outside = passed, inside
            count = inside.count()

    def contains(self, key: Column) -> Column:
        """Exact membership for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            bits, hashes = self.levels[level]
            out = F.when(_passes(key, level, bits, hashes), out).otherwise(F.lit(level % 2 == 1))
        return out


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host + path) that fits, as ``struct(rule, verdict)``; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the rule's, else block for listed hosts, else allow."""
    out = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    listed = stored(listed.select("key").where("key is not null").distinct())
    if listed.count() <= MAX_KEYS:
        universe = out.select(F.col("host").alias("key")).distinct()
        out = out.withColumn("_listed", Cascade(universe, listed).contains(F.col("host")))
    else:
        out = out.join(listed.select(F.col("key").alias("_key")), F.col("host") == F.col("_key"), "left")
        out = out.withColumn("_listed", F.col("_key").isNotNull()).drop("_key")
    out = out.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("_rule.rule"))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_rule", "_listed")
