"""Operators on document tables against brute force, on small fixtures with nulls, repeats, ties and clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import resemble.llm.decontaminate as decon
import resemble.llm.neardup as neardup
import resemble.llm.substrings as substrings
from resemble.llm.graph import components

SYLLABLES = "an re ti on en the ou al ing er is at ed or".split()


def words(seed, n):
    out = []
    for i in range(n):
        h = int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), 16)
        out.append("".join(SYLLABLES[(h >> (4 * k)) % len(SYLLABLES)] for k in range(1 + h % 3)))
    return out


def edited(base, places, mark):
    return [f"{mark}{i}" if i in places else w for i, w in enumerate(base)]


def fixture_texts():
    a, b, long = words("a", 60), words("b", 40), words("long", 3000)
    texts = {10: " ".join(a), 4: " ".join(a).upper(), 7: " ".join(edited(a, {5}, "x")), 12: " ".join(edited(a, {5, 30}, "y")),
             13: " ".join(edited(a, {30, 50}, "z")), 20: " ".join(b), 21: " ".join(b[:20] + words("c", 20)), 30: "", 31: None, 32: " \t\n ",
             33: "one two", 34: "two one", 35: "One  two", 36: "one", 40: " ".join(long), 41: " ".join(edited(long, {9}, "q"))}
    for k in range(8):
        texts[50 + k] = " ".join(edited(a, {k * 6, k * 6 + 1}, f"m{k}"))
    return texts


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute_groups(texts, width, percent):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(root[a], root[b])
                    if root[a] != low or root[b] != low:
                        root[a] = root[b] = low
                        changed = True
    return {k: (len(sets[k]), root[k]) for k in texts}


@pytest.mark.parametrize("width,percent,chunk_rows", [(3, 85, 2048), (5, 80, 2048), (3, 60, 4)])
def test_near_groups_match_brute_force(spark, monkeypatch, width, percent, chunk_rows):
    monkeypatch.setattr(neardup, "CHUNK_ROWS", chunk_rows)  # 4: clusters are cut into several chunks
    texts = fixture_texts()
    df = (
        spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(10, texts[10], 1)], "doc_id long, text string, n long"))
    got = neardup.near_groups(df, width, percent).collect()
    assert len(got) == len(texts) + 1
    expected = brute_groups(texts, width, percent)
    assert {r[0]: (r[1], r[2]) for r in got} == expected


def test_near_groups_without_rows_ids_or_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_groups(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, None)], "doc_id long, text string")
    got = sorted((r[0] is not None, r[0], r[1], r[2]) for r in neardup.near_groups(df).collect() if r[0] is not None)
    assert got == [(True, 1, 0, 1), (True, 2, 2, 2)]
    kept = neardup.keep_one(df)
    assert sorted(str(r[0]) for r in kept.collect()) == ["1", "2", "None", "None"]


def test_keep_one_keeps_one_row_of_repeated_rows(spark):
    texts = fixture_texts()
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] * 2, "doc_id long, text string")
    kept = sorted(r[0] for r in neardup.keep_one(df, 3, 85).collect())
    assert kept == sorted({root for _, root in brute_groups(texts, 3, 85).values()})


def test_match_threshold_bounds_the_miss_chance():
    from math import comb
    m = neardup.match_threshold(85)
    assert sum(comb(64, i) * .85 ** i * .15 ** (64 - i) for i in range(m)) < neardup.MISS
    assert 32 < m < 54


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 5), (300, 299)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, " ".join(words("i1", 30))), (2, "Short item-here"), (3, None), (4, "..."), (5, " ".join(words("i5", 13))), (11, "short ITEM here"),
         (6, "é" + " ".join(words("i6", 20)))]


def decon_docs():
    i1, i5, i6 = words("i1", 30), words("i5", 13), words("i6", 20)
    return [(1, " ".join(words("d1", 20) + i1[3:20] + words("d2", 400))), (2, "a short, item; HERE! b"), (3, None), (4, ""),
            (5, " ".join(i5).upper()), (6, " ".join(i5[:12] + ["zz"] + i5)), (7, " ".join(words("d7", 50))), (8, "short item"),
            (9, "É" + " ".join(i6)), (9, "é" + " ".join(i6)), (10, " ".join(i1 * 3)), (12, " ".join(i1[:13] + i1[1:14]))]


def brute_hits(text, items):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = split.findall((text or "").translate(fold))
    hit, found = set(), set()
    for item, t in items:
        iw = split.findall((t or "").translate(fold))
        wins = [iw[i:i + 13] for i in range(len(iw) - 12)] if len(iw) >= 13 else [iw] if iw else []
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_benchmark_hits_match_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, 7) for i, t in decon_docs()], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")
    got = decon.judged(decon.find_benchmark(docs, bench, block_bytes=block_bytes)).collect()
    seen = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got)
    expected = []
    for i, t in decon_docs():
        n, h, items = brute_hits(t, ITEMS)
        expected.append((i, n, h, tuple(items), h > 0 and 20 * h >= n))
    assert seen == sorted(expected)
    kept = decon.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(e[0] for e in expected if not e[4])


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decon.find_benchmark(docs, none).collect()] == [(1, "a b", 2, [], [])]
    assert decon.find_benchmark(docs.limit(0), none).count() == 0


def brute_repeats(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k:k + 50]
            least[s] = min(least.get(s, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k:k + 50]] < ((1 << 62) if i is None else i):
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block,spread,shard", [(16 << 20, 8 << 20, 1 << 20), (3_000, 2_000, 600)])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, block, spread, shard):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "SPREAD_BYTES", spread)
    texts = fixture_texts()
    passage = "é" + " ".join(words("p", 30))
    rows = list(texts.items()) + [(10, texts[10]), (60, passage + passage), (61, "x" * 200), (62, "y" + "x" * 120 + "z"), (63, passage[:49]),
                                  (64, passage.encode()[1:].decode("utf8", "ignore")), (None, passage), (65, " ".join(words("n", 30)) + passage + " ".join(words("o", 30)) + passage)]
    rows = [(i, t if t is None else t[:4000]) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:5] for r in substrings.remove_repeats(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)
    assert substrings.remove_repeats(df.limit(0)).count() == 0
