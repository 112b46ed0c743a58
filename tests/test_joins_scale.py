"""Set and fingerprint joins, the packed index and the stemmer's dictionary: exactness, candidates, plan shapes."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from resemble.functions import stem
from resemble.functions.metrics import _majority, with_fingerprint
from resemble.operators import simjoin
from resemble.operators.postings import many_mains_overlap
from resemble.plans.stem_rules import stem_steps

SF = "/root/testdata/sf0.001"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "key long, content string")


def random_sets(n, seed):
    """Rows of few frequent and many rare words; some are near copies of others."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        if i > 5 and rnd.random() < 0.4:
            words = rows[rnd.randrange(i)][1].split()
            for _ in range(rnd.randrange(4)):
                if words:
                    words[rnd.randrange(len(words))] = f"w{rnd.randrange(3000)}"
        else:
            words = [f"f{rnd.randrange(12)}" if rnd.random() < 0.5 else f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(60))]
        rows.append((i, " ".join(words)))
    return rows


def shared(rows_a, rows_b, metric, threshold):
    a, b = ({k: set(t.split()) for k, t in rows} for rows in (rows_a, rows_b))
    out = {}
    for x, s in a.items():
        for y, t in b.items():
            n = len(s & t)
            if n:
                v = n / len(s | t) if metric == "jaccard" else n / (len(s) ** 0.5 * len(t) ** 0.5)
                if round(v * 100 + 1e-9, 2) >= threshold:
                    out[x, y] = n
    return out


@pytest.mark.parametrize("metric,threshold", [("jaccard", 70.0), ("jaccard", 20.0), ("cosine", 55.5), ("cosine", 100.0)])
def test_set_join_matches_all_pairs(spark, metric, threshold):
    rows = random_sets(220, 3) + [(900, ""), (901, "f1"), (902, "f1")]
    got = simjoin.set_join(corpus(spark, rows), metric, threshold, stem=False).collect()
    rep = {r.doc_a: r.doc_b for r in got if r.kind == "copy"}
    near = {(r.doc_a, r.doc_b) for r in got if r.kind == "near"}
    classes = {}
    for k, _ in rows:
        classes.setdefault(rep.get(k, k), []).append(k)
    pairs = {tuple(sorted(p)) for members in classes.values() for p in itertools.combinations(members, 2)}
    for a, b in near:
        pairs |= {tuple(sorted(p)) for p in itertools.product(classes[a], classes[b])}
    want = {p for p in shared(rows, rows, metric, threshold) if p[0] < p[1]}
    assert pairs == want and len(want) > 5


def test_stop_words_make_no_candidates(spark):
    rows = [(i, "the of and to in " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(300)]
    reps, _ = simjoin._representatives(corpus(spark, rows), stem=False)
    assert simjoin.set_candidates(reps, "jaccard", 70.0).count() == 0


def test_bitmaps_turn_away_most_candidates(spark, monkeypatch):
    # the same rare word in front, all else different
    rows = [(i, "rare " + " ".join(f"w{i}x{j}" for j in range(80))) for i in range(60)]
    sets = simjoin.materialize(simjoin.hashed_sets(corpus(spark, rows), stem=False))
    flat = sets.select("key", F.size("h").alias("n"), F.sort_array("h").alias("ids"))
    with_bits = simjoin.set_candidates(flat, "jaccard", 30.0).count()
    monkeypatch.setattr(simjoin, "_bitmap", lambda ids: F.expr("array_repeat(0L, 8)"))
    without = simjoin.set_candidates(flat, "jaccard", 30.0).count()
    assert without > 100 and with_bits < without / 10


def test_sets_of_many_tokens_are_told_apart_before_they_move(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{j}" for j in rnd.sample(range(1_500), rnd.choice((450, 600, 700))))) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace("w1", "v1", 60 * i)) for i in range(8)]
    sets, _ = simjoin._representatives(corpus(spark, rows), stem=False)
    cand = simjoin.set_candidates(sets, "cosine", 70.0)
    # the first copy is not changed at all: an edge of kind copy
    want = {p for p in shared(rows, rows, "cosine", 70.0) if p[0] < p[1] and 100 not in p}
    got = {(r.ka, r.kb) for r in simjoin._likely(cand, sets, sets, "cosine", 70.0).collect()}
    assert cand.count() > 600 and len(got) < 60 and want <= got
    near = simjoin.set_join(corpus(spark, rows), "cosine", 70.0, stem=False).where("kind = 'near'").collect()
    assert {(r.doc_a, r.doc_b) for r in near} == want


def test_fitting_bitmaps_cost_a_sets_tokens(spark):
    """They cost the tokens times the longs: minutes for a set of 100,000."""
    rnd = random.Random(12)
    # rows of a repeated key have a bitmap each, equal rows too
    sets = [(k, sorted(rnd.getrandbits(62) for _ in range(n))) for k, n in ((1, 0), (2, 1), (3, 21), (4, 22), (5, 700), (5, 90))]
    sets += [sets[-1], (6, [rnd.getrandbits(62) for _ in range(100_000)])]

    def bitmap(ids):
        w = [0] * (1 << max(0, (max(len(ids) * 3 / 64, 1) - 1e-12).__ceil__() - 1).bit_length())
        for x in ids:
            w[x & len(w) - 1] ^= 1 << (x >> 32 & 63)
        return w

    df = spark.createDataFrame([(k, len(ids), ids) for k, ids in sets], "key long, n int, ids array<long>")
    begun = time.monotonic()
    got = simjoin._bitmaps(df).collect()
    assert time.monotonic() - begun < 30
    got = sorted((r.key, r.n, [x & (1 << 64) - 1 for x in r.w]) for r in got)
    assert got == sorted((k, len(ids), bitmap(ids)) for k, ids in sets)


def test_a_pairs_smaller_set_gives_a_shorter_prefix(spark):
    """Both sides of the join had the prefix that only a pair's larger set needs."""
    ids = [list(range(1000 * k, 1000 * k + 100)) for k in range(10)]
    df = spark.createDataFrame([(k, 100, x) for k, x in enumerate(ids)], "key long, n int, ids array<long>")
    df = df.withColumn("n", F.col("n") + 0)
    for metric, want in (("cosine", {31, 52}), ("jaccard", {18, 31})):
        plan = simjoin.set_candidates(df, metric, 70.0)._jdf.queryExecution().optimizedPlan()
        join = next(plan.apply(k) for k in range(60) if plan.apply(k).nodeName() == "Join")
        sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side) for side in (join.left(), join.right())]
        assert {side.count() // 10 for side in sides} == want


def test_rows_of_a_repeated_key_make_no_more_pairs(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i k"), (2, "a b c d e f g h i l")]
    got = simjoin.set_join(corpus(spark, rows), "jaccard", 70.0, stem=False).collect()
    # each row of key 1 against the one of key 2
    assert sorted((r.doc_a, r.doc_b, r.similarity) for r in got if r.doc_a != r.doc_b) == [(1, 2, 81.82)] * 2


def test_set_join_plan_has_no_window(spark):
    plan = simjoin.set_join(corpus(spark, random_sets(30, 1)), "jaccard", 70.0)._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_fingerprints_are_row_local(spark):
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i)]) for i in range(40)], "key int, t array<string>")
    out = with_fingerprint(df, "t", "fp")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    from hashlib import md5

    for r in out.collect():
        hashes = [int(md5(t.encode()).hexdigest()[16:], 16) for t in r.t]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fp & (2 ** 64 - 1) == want


def test_fingerprints_at_the_bounds_of_the_lanes(spark):
    from hashlib import md5

    sizes = [125, 126, 127, 128, 32_766, 32_767]
    df = spark.range(len(sizes)).select("id", F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") + 1).cast("int")).alias("n"))
    df = df.select("n", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i % 3 == 0, F.lit("same")).otherwise(i.cast("string"))).alias("t"))
    hashes = {}
    for r in with_fingerprint(df, "t", "fp").select("n", "fp").collect():
        count = [0] * 64
        for i in range(1, r.n + 1):
            t = "same" if i % 3 == 0 else str(i)
            if t not in hashes:
                hashes[t] = int(md5(t.encode()).hexdigest()[16:], 16)
            for b in range(64):
                count[b] += hashes[t] >> b & 1
        assert r.fp & (2 ** 64 - 1) == sum(1 << b for b in range(64) if 2 * count[b] > r.n)
    # all bits in all hashes: no lane runs over
    full = spark.range(1).select(F.array_repeat(F.lit(-1).cast("long"), 126).alias("_h"))
    for lane, n in ((8, 126), (16, 32_766)):
        assert spark.range(1).select(F.array_repeat(F.lit(-1).cast("long"), n).alias("_h")).select(F.expr(_majority(lane))).first()[0] == -1
    assert full.select(F.expr(_majority(32))).first()[0] == -1


def test_python_gets_few_texts_at_a_time(spark):
    """Stems and LCS lengths take rows one by one: no Arrow batch of whole texts."""
    from resemble.functions.metrics import fuzzy_ratio_udf
    from resemble.functions.tokens import with_tokens

    df = with_tokens(spark.createDataFrame([("running runners",)], "t string"), "t", "w").select(fuzzy_ratio_udf(F.array_join("w", " "), "t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_tables_meet_all_near_fingerprints(spark, bits):
    rnd = random.Random(bits)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in range(1, bits + 2):
            x = b
            for pos in rnd.sample(range(64), d):
                x ^= 1 << pos
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "key long, fp long")
    cand = simjoin.fingerprint_candidates(df, bits)
    got = {(r.doc_a, r.doc_b) for r in cand.where(F.col("d") <= bits).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= bits}
    assert got == want and len(simjoin.block_masks(bits)) == {1: 2, 2: 6, 3: 20, 4: 70}[bits]
    assert all((m & (2 ** 64 - 1)).bit_count() in (31, 32, 33) for m in simjoin.block_masks(bits))


def test_candidates_grow_with_the_rows_not_their_square(spark):
    """Fingerprints without relation: four bands of 16 bits would give some n² / 32,768 candidates."""
    rnd = random.Random(11)
    n = 6_000
    df = spark.createDataFrame([(i, rnd.getrandbits(64) - (1 << 63)) for i in range(n)], "key long, fp long")
    assert simjoin.fingerprint_candidates(df, 3).count() < 50


@pytest.mark.parametrize("metric,threshold,piece", [("cosine", 20.0, 32 << 20), ("cosine", 0.0, 900), ("jaccard", 12.5, 3_000)])
def test_packed_index_matches_all_pairs(spark, metric, threshold, piece):
    mains, docs = random_sets(30, 5) + [(500, "")], random_sets(150, 6) + [(700, ""), (701, "f1 f2"), (701, "f1 f2")]
    out = many_mains_overlap(corpus(spark, mains), corpus(spark, docs).repartition(3), metric, threshold, piece_bytes=piece, stem=False)
    got = [tuple(r) for r in out.select("main_key", "sub_key", "inter").collect()]
    want = shared(mains, docs, metric, threshold)
    assert {(a, b): n for a, b, n in got} == want and len(want) > 20
    assert len(got) == len(want) + sum(b == 701 for _, b in want)


def test_packed_index_of_no_mains_and_string_keys(spark):
    none = spark.createDataFrame([], "key string, content string")
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "key string, content string")
    assert many_mains_overlap(none, docs, "cosine", 10.0).count() == 0
    assert [tuple(r) for r in many_mains_overlap(docs, docs, "cosine", 10.0).collect()] == [("a", "a", 2, 100.0)]


def rules_in_python(word):
    for pattern, new in stem_steps():
        word = re.sub("(?m)" + pattern, new.replace("$1", r"\1"), word)
    return word.lower()


def test_stemmer_agrees_with_the_rules_as_patterns(spark):
    from resemble.functions.tokens import words

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary = {r.w for r in docs.select(F.explode(words(F.col("text"))).alias("w")).distinct().collect()}
    rnd = random.Random(2)
    endings = ("s ies ied eed ed ing y ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti "
               "iviti biliti fulli logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize e ll").split()
    made = {"".join(rnd.choice("abceilnorsty") for _ in range(rnd.randrange(1, 6))) + rnd.choice(endings) + rnd.choice(["", "", rnd.choice(endings)])
            for _ in range(20_000)}
    assert len(vocabulary) > 10_000
    different = {w: (stem.stem_word(w), rules_in_python(w)) for w in sorted(vocabulary) + sorted(made) if stem.stem_word(w) != rules_in_python(w)}
    assert different == {}


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(stem, "MEMO_WORDS", 3)
    memo = stem._Memo()
    assert [memo[w] for w in "cats dogs running flies cats happily".split()] == ["cat", "dog", "run", "fli", "cat", "happili"]
    assert len(memo) <= 3
