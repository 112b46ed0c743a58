"""DuckDB SQL fragments for the oracle twins.

The fragments spell the token contract of ``functions/tokens.py`` in DuckDB
SQL, from the same fixed patterns (RE2 and Java agree on every construct the
patterns use).  They exist only to write the independent twin queries in
``plans/oracle.py``; nothing in the Spark path uses them.
"""

from __future__ import annotations

from resemble.functions.tokens import BREAK_CHARS, NBSP, WS_CLASS, regex_steps
from resemble.plans.stem_rules import stem_steps


def lit(s: str) -> str:
    """A DuckDB string literal (standard SQL: quotes doubled, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


def words_sql(expr: str) -> str:
    """Normalised words of ``expr`` as a DuckDB list (twin of ``tokens.words``)."""
    s = f"translate(coalesce({expr}, ''), {lit(NBSP + BREAK_CHARS)}, {lit(' ' * (1 + len(BREAK_CHARS)))})"
    for pattern, repl in regex_steps():
        s = f"regexp_replace({s}, {lit(pattern)}, {lit(repl.replace('$1', chr(92) + '1'))}, 'g')"
    return f"list_filter(string_split_regex(lower({s}), {lit(WS_CLASS + '+')}), lambda x: x <> '')"


def word_ngrams_sql(t: str, lo: int, hi: int) -> str:
    """Twin of ``tokens.word_ngrams`` over a DuckDB list expression ``t``."""
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            parts.append(
                f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
                f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)")
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"


def char_ngrams_sql(t: str, lo: int, hi: int) -> str:
    """Twin of ``tokens.char_ngrams``."""
    c = f"array_to_string({t}, '')"
    parts = [
        f"(CASE WHEN length({c}) >= {n} THEN list_transform(range(1, length({c}) - {n} + 2), "
        f"lambda i: substring({c}, i, {n})) ELSE []::VARCHAR[] END)"
        for n in range(lo, hi + 1)
    ]
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"


def cosine_sql(a: str, b: str) -> str:
    """M1 over two DuckDB lists."""
    return (f"(CASE WHEN len(list_distinct({a})) = 0 OR len(list_distinct({b})) = 0 THEN 0.0 ELSE "
            f"round(len(list_intersect(list_distinct({a}), list_distinct({b}))) / "
            f"(sqrt(len(list_distinct({a}))) * sqrt(len(list_distinct({b})))) * 100, 2) END)")


def jaccard_sql(a: str, b: str) -> str:
    """M2 over two DuckDB lists."""
    i = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    u = f"(len(list_distinct({a})) + len(list_distinct({b})) - {i})"
    return f"(CASE WHEN {u} = 0 THEN 0.0 ELSE round({i} / {u} * 100, 2) END)"


def hash64_sql(t: str) -> str:
    """Low 64 bits of md5 as a signed BIGINT."""
    u = f"('0x' || substr(md5({t}), 17, 16))::UBIGINT"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN ({u}::HUGEINT - 18446744073709551616)::BIGINT ELSE {u}::BIGINT END)"


def fingerprint_sql(tokens: str) -> str:
    """Simhash of a DuckDB list as a signed BIGINT (twin of ``simhash_fingerprints``)."""
    hashes = f"list_transform({tokens}, lambda t: {hash64_sql('t')})"
    bits = []
    for i in range(64):
        cnt = f"len(list_filter({hashes}, lambda h: (h >> {i}) & 1 = 1))"
        weight = "(-9223372036854775808)::BIGINT" if i == 63 else f"{1 << i}::BIGINT"
        bits.append(f"(CASE WHEN 2 * {cnt} > len({tokens}) THEN {weight} ELSE 0::BIGINT END)")
    return "(" + " | ".join(bits) + ")"


def stem_sql(t: str) -> str:
    """Stems of a DuckDB list, by the rules as regular expressions."""
    s = f"array_to_string({t}, chr(10))"
    for pattern, new in stem_steps():
        s = f"regexp_replace({s}, {lit('(?m)' + pattern)}, {lit(new.replace('$1', chr(92) + '1'))}, 'g')"
    return f"list_filter(string_split(lower({s}), chr(10)), lambda x: x <> '')"
