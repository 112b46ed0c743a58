"""Tokens and n-grams as native Column expressions.

The word splitter is a chain of ``regexp_replace`` calls over the whole text
followed by one ``split``: everything stays inside whole-stage codegen, and no
Python runs; stemming (``stem.py``) is a further chain of the same kind.

The patterns use only the regex features that Java and RE2 share (classes,
alternation, groups, ``^``/``$``; no look-around), so that the DuckDB twins in
``plans/oracle.py`` run the very same patterns.

Token contract
--------------
1.  NBSP becomes a space.
2.  ``; ! " % ( ) [ ] { } ' ` ’ $`` break words (they become spaces).
3.  The marks in ``MARKS`` become tokens of their own.
4.  A non-ASCII currency sign is followed by a break.
5.  Runs of two or more ``-``, ``.`` or ``,`` break.
6.  A single ``,`` breaks unless a digit follows (``1,000`` stays one word).
7.  ``:`` breaks unless ``//`` follows (``http://x`` stays one word).
8.  Split on ASCII whitespace; strip ASCII punctuation at both ends of each
    word; lower-case; drop empty words.

``?`` before whitespace, and ASCII punctuation at a word's end in general, need
no rule of their own: step 8 strips them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the token contract (shared with the DuckDB twins).
# ---------------------------------------------------------------------------
NBSP = "\u00a0"
BREAK_CHARS = ";!\"%()[]{}'`’$"
MARKS = "؛،¿¡«»‹›“”„‚‘…°©®٪±–—"
CURRENCY_CLASS = "[\u00a2-\u00a5\u20a0-\u20cf]"
WS_CLASS = r"[\x09-\x0D\x20]"
PUNCT_CLASS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
RUNS_PATTERN = r"--+|\.\.+|,,+"
COMMA_PATTERN = r",([^0-9]|$)"
COLON_PATTERN = r":([^/]|/[^/]|/$|$)"
MAX_NGRAM = 20
UNITS = ("word", "character")
# ---------------------------------------------------------------------------


def _marks_class() -> str:
    return "([" + MARKS + "])"


def regex_steps() -> list[tuple[str, str]]:
    """The replace steps 3-8 as ``(pattern, replacement-with-$1)`` pairs, in order."""
    return [
        (_marks_class(), " $1 "),
        ("(" + CURRENCY_CLASS + ")", "$1 "),
        (RUNS_PATTERN, " "),
        (COMMA_PATTERN, " $1"),
        # a colon kept as the look-ahead character of the previous match is
        # always preceded by a space or '/', so a second pass catches it
        (COLON_PATTERN, " $1"),
        (COLON_PATTERN, " $1"),
        ("(^|" + WS_CLASS + ")" + PUNCT_CLASS + "+", "$1"),
        (PUNCT_CLASS + "+(" + WS_CLASS + "|$)", "$1"),
    ]


def clamp_ngram(unit: str = "word", min_ngram: int = 1, max_ngram: int = 1) -> tuple[str, int, int]:
    """bounds of the n-gram range, 1 to ``MAX_NGRAM``, low end first; unknown unit -> word."""
    low = max(int(min_ngram), 1)
    high = max(min(max(int(max_ngram), 1), MAX_NGRAM), low)
    return unit if unit in UNITS else UNITS[0], low, high


def decode_utf8(raw: Column) -> Column:
    """Bytes as text, bad bytes dropped.

    Valid bytes are taken as they are; in others each bad sequence becomes
    U+FFFD, which is then removed together with any that the bytes spelt out.
    """
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def clean_text(text: Column) -> Column:
    """Null -> '' (missing values are empty strings, never null)."""
    return F.coalesce(text.cast("string"), F.lit(""))


def normalized_text(text: Column) -> Column:
    """Steps 1-8 up to, not including, the split: one string, lower-cased."""
    s = F.translate(clean_text(text), NBSP + BREAK_CHARS, " " * (1 + len(BREAK_CHARS)))
    marks, *steps = regex_steps()
    # Java tests the range first, so that an ASCII character isn't held against each mark
    s = F.regexp_replace(s, f"([\\u0080-\\uffff&&[{MARKS}]])", marks[1])
    for pattern, repl in steps:
        s = F.regexp_replace(s, pattern, repl)
    return F.lower(s)


def words(text: Column) -> Column:
    """T1 + T2 without stemming: ``array<string>`` of normalised words in order."""
    return F.array_remove(F.split(normalized_text(text), WS_CLASS + "+"), "")


def explode_items(df: DataFrame, keep: list, array_col, out: str) -> DataFrame:
    """One row per element of ``array_col`` (rows with empty arrays vanish).

    ``explode`` would make Catalyst infer ``size(array) > 0`` and push it below
    the projection that computes the array, evaluating the whole tokeniser a
    second time (before any repartition); ``explode_outer`` plus a filter on the
    generated column cannot move below the generator.
    """
    col = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keep, F.explode_outer(col).alias(out)).where(F.col(out).isNotNull())


def _ngrams_of(items: Column, n: int, sep: str) -> Column:
    if n == 1:
        return items
    windows = F.transform(
        F.sequence(F.lit(1), F.size(items) - n + 1),
        lambda i: F.array_join(F.slice(items, i, n), sep),
    )
    # sequence(1, 0) is [1, 0], hence the guard
    return F.when(F.size(items) >= n, windows).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens: Column, min_ngram: int, max_ngram: int) -> Column:
    """T4: for n = min..max, every length-n window joined by one space, in order."""
    parts = [_ngrams_of(tokens, n, " ") for n in range(min_ngram, max_ngram + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _substring_of(chars: Column, n: int):
    # a one-argument lambda: ``transform`` passes (element, index) to two-argument ones
    return lambda i: F.substring(chars, i, n)


def char_ngrams(tokens: Column, min_ngram: int, max_ngram: int) -> Column:
    """T5 over an already joined string column: code-point windows for n = min..max.

    ``tokens`` must be a plain column reference (see :func:`with_tokens`), so
    that nothing expensive is re-evaluated inside the lambdas.
    """
    chars = tokens
    parts = []
    for n in range(min_ngram, max_ngram + 1):
        windows = F.transform(F.sequence(F.lit(1), F.length(chars) - n + 1), _substring_of(chars, n))
        parts.append(F.when(F.length(chars) >= n, windows).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def with_tokens(df: DataFrame, text: str | Column, out: str, unit: str = "word", min_ngram: int = 1,
                max_ngram: int = 1, stem: bool = True) -> DataFrame:
    """Tokens of a text as the comparisons use them, as a new column ``out``: split, normalised, stemmed, n-grams.

    Parameters are clamped by :func:`clamp_ngram` first, as the reference does.
    Words are materialised in their own projection before the n-gram lambdas
    refer to them; Catalyst keeps that projection because the n-gram
    expression uses the words more than once, so the regex chain runs once per
    text.
    """
    unit, min_ngram, max_ngram = clamp_ngram(unit, min_ngram, max_ngram)
    text_col = F.col(text) if isinstance(text, str) else text
    if not stem and unit == "word" and min_ngram == max_ngram == 1:
        return df.withColumn(out, words(text_col))
    df = df.withColumn("_words", words(text_col))
    if stem:
        from resemble.functions.stem import stem_tokens

        df = df.withColumn("_words", stem_tokens(F.col("_words")))
    if unit == "character":
        df = df.withColumn("_words", F.array_join(F.col("_words"), ""))
        return df.withColumn(out, char_ngrams(F.col("_words"), min_ngram, max_ngram)).drop("_words")
    return df.withColumn(out, word_ngrams(F.col("_words"), min_ngram, max_ngram)).drop("_words")
