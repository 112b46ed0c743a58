"""Fixtures B1-B4 and metric properties."""

from pyspark.sql import functions as F

from resemble.functions import metrics as M
from resemble.functions import tokens as tk
from resemble.functions.stem import stem_tokens

A = "This is a foo ba"
B = "This sentence is similar to a foo bar sentence"


def _pair(spark, a, b):
    df = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    return df


def test_b1_metrics(spark):
    df = _pair(spark, A, B)
    row = df.select(M.jaccard(F.col("a"), F.col("b")).alias("j"), M.cosine(F.col("a"), F.col("b")).alias("c"),
                    M.fuzzy_ratio_udf(M.fuzzy_prepare(F.col("a")), M.fuzzy_prepare(F.col("b"))).alias("f")).first()
    assert row.j == 44.44
    assert row.c == 63.25
    assert row.f == 52
    fps = M.simhash_fingerprints(spark.createDataFrame([(1, A.split()), (2, B.split())], "k int, t array<string>"),
                                 ["k"], "t").orderBy("k").collect()
    assert 100 - bin((fps[0].fingerprint ^ fps[1].fingerprint) & (2 ** 64 - 1)).count("1") == 83


def test_empty_edges(spark):
    df = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    row = df.select(M.jaccard(F.col("a"), F.col("b")).alias("j"), M.cosine(F.col("a"), F.col("b")).alias("c"),
                    M.fuzzy_ratio_udf(M.fuzzy_prepare(F.col("a")), M.fuzzy_prepare(F.col("b"))).alias("f"),
                    M.simhash_compare(F.lit(0), F.size("a"), F.lit(0), F.size("b")).alias("s")).first()
    assert (row.j, row.c, row.f, row.s) == (0.0, 0.0, 0, 0)


def test_equal_sets_score_100(spark):
    df = _pair(spark, B, B)
    row = df.select(M.jaccard(F.col("a"), F.col("b")).alias("j"), M.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.j == 100.0 and row.c == 100.0
    assert M.fuzzy_ratio("abc", "abc") == 100


def test_lcs_against_table():
    import random

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(7)
    for _ in range(200):
        a = "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 40)))
        b = "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, 40)))
        assert M.lcs_length(a, b) == slow(a, b)


def test_b2_char_ngrams(spark):
    df = spark.createDataFrame([("what are you doing",)], "text string")
    out = tk.with_tokens(df, "text", "t", "character", 1, 3, stem=True).first().t
    assert len(out) == 33 and out[0] == "w" and out[-1] == "udo"


def test_b3_word_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [])], "t array<string>, e array<string>")
    row = df.select(tk.word_ngrams(F.col("t"), 1, 2).alias("x"), tk.word_ngrams(F.col("t"), 4, 4).alias("y"),
                    tk.word_ngrams(F.col("e"), 1, 1).alias("z")).first()
    assert row.x == ["a", "b", "c", "a b", "b c"] and row.y == [] and row.z == []


def test_b4_clamp():
    assert tk.clamp_ngram("word", 0, 0) == ("word", 1, 1)
    assert tk.clamp_ngram("word", 1, 25) == ("word", 1, 20)
    assert tk.clamp_ngram("word", 25, 1) == ("word", 25, 25)
    assert tk.clamp_ngram("word", 3, 2) == ("word", 3, 3)
    assert tk.clamp_ngram("word", -1, 5) == ("word", 1, 5)
    assert tk.clamp_ngram("line", 1, 1) == ("word", 1, 1)


def test_token_contract(spark):
    text = "Hello, World! 1,000 cats;dogs http://x.org/a “quoted” a--b e.g. don't US$5 50€"
    out = spark.createDataFrame([(text,)], "text string").select(tk.words(F.col("text")).alias("w")).first().w
    assert out == ["hello", "world", "1,000", "cats", "dogs", "http://x.org/a", "“", "quoted", "”", "a", "b",
                   "e.g", "don", "t", "us", "5", "50€"]


STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalization": "gener",
    "are": "are", "doing": "do", "controlling": "control", "roll": "roll", "probate": "probat", "effective": "effect",
    "died": "die", "lied": "lie", "tied": "tie", "ties": "tie", "cried": "cri", "geology": "geolog", "theology": "theolog",
    "conditionally": "condit", "national": "nation", "rational": "ration", "skies": "sky", "dying": "die", "innings": "inning",
    "by": "by", "say": "say", "enjoy": "enjoy", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "sized": "size", "adoption": "adopt",
    "replacement": "replac", "controll": "control", "rate": "rate", "cease": "ceas", "é": "é", "1,000": "1,000", "x" * 3000: "x" * 3000}


def test_stem_examples(spark):
    words = list(STEMS) * 2
    out = spark.createDataFrame([(words,), ([],), (None,)], "t array<string>").select(stem_tokens(F.col("t")).alias("s")).collect()
    assert out[0].s == list(STEMS.values()) * 2
    assert out[1].s == [] and not out[2].s


def test_decode_utf8_drops_bad_bytes(spark):
    rows = [(b"plain",), (b"a\xffb\xc3",), ("é\ufffd".encode(),), (b"",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(tk.decode_utf8(F.col("b")).alias("t")).collect()]
    assert got == ["plain", "ab", "é\ufffd", "", None]
