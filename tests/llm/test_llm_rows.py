"""Mixing, line dedup, language ID, URL filter, chat and sketches against brute force and invariants."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from resemble.llm import langid, mixing, sketch
from resemble.llm.chat import rotate
from resemble.llm.linededup import dedup_lines
from resemble.llm.urlfilter import Cascade, judge_urls

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


# ---- mixing ----

def capped_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The contract's loop: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total, over = sum(w[s] for s in free), 0.0
        for s in free:
            target[s] += left * w[s] / total
        for s in list(free):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
        left = over
    return target


def mix_docs():
    rows = []
    for i in range(400):
        source = None if i % 17 == 0 else ["big", "big", "mid", "Zed", "é"][i % 5]
        n = int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 40
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(n)) if i % 50 else None, source, i))
    rows += [(7, rows[7][1], rows[7][2], 7)] * 3 + [(None, "a b c", "mid", 0)] + [(900, "word " * 3000, "one", 1)]
    return rows


def test_mix_meets_its_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(mix_docs(), "doc_id long, text string, source string, size int")
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(mix_docs())
    sizes, taken, target = {}, {}, {}
    by_row = [(r, next(d for d in mix_docs() if d[0] == r["doc_id"])) for r in got]
    for r, d in by_row:
        assert r["size"] == len((d[1] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[d[2]] = sizes.get(d[2], 0) + r["size"]
        taken[d[2]] = taken.get(d[2], 0) + r["taken"]
        target[d[2]] = r["target"]
    expected = capped_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 4
    again = mixing.mix_counts(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_rows_hold_the_words_they_take(spark):
    df = spark.createDataFrame(mix_docs(), "doc_id long, text string, source string, size int")
    counts = mixing.mix_counts(df)
    expected = counts.agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "take", "shard", "shuffle_key"]
    rows = mixed.collect()
    assert sum(len(r["text"].split()) for r in rows) == expected
    assert {r["shard"] for r in rows} <= set(range(16))
    with pytest.raises(ValueError):
        mixing.mix_counts(df, shards=12)


def test_splitting_tree_halves_every_node_and_keeps_all_units(spark):
    units = spark.createDataFrame([(s, i) for s, n in (("a", 500), ("b", 77), ("c", 3)) for i in range(1, n + 1)], "_src string, _unit long")
    rows = mixing._split_units(units, 8, 5).collect()
    assert len({(r["_src"], r["_unit"]) for r in rows}) == 580
    per = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(per) - min(per) <= 3
    # a shard's share of a source is near proportion: a hypergeometric draw, not a run of one source
    assert all(45 <= sum(r["shard"] == s and r["_src"] == "a" for r in rows) <= 73 for s in range(8))


def test_mix_of_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r)[:5] for r in mixing.mix_counts(df).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(df).count() == 0 and mixing.mix_counts(df.limit(0)).count() == 0


# ---- lines ----

def line_norm(line):
    return re.sub("[\x00-\x60\x7b-\x7f]+", " ", line.lower()).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs):
    """All pairs of different normal forms by the edit rule, connected groups, the first line of each stays."""
    norms = {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            n = line_norm(line)
            if n:
                norms.setdefault(n, []).append((i, p))
    root = {n: n for n in norms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(norms)
    for x in range(len(names)):
        for y in range(x):
            a, b = names[x].split(" "), names[y].split(" ")
            if 0 < distance(a, b) <= max(len(a), len(b)) * 20 // 100:
                root[find(names[x])] = find(names[y])
    groups = {}
    for n, places in norms.items():
        groups.setdefault(find(n), []).extend(places)
    gone = {p for places in groups.values() for p in places if p != min(places)}
    return {i: (len((t or "").split("\n")), sum(g[0] == i for g in gone),
                "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone)) for i, t in docs}


def line_docs():
    base = ["word" + "".join("abcdefghij"[int(c)] for c in str(k)) for k in range(70)]
    near = [" ".join(base), " ".join(base[:40] + ["wordx"] + base[41:]), " ".join(base[:60] + ["other"] + base[61:]), " ".join(reversed(base))]
    letters = ["".join("abcdefghij"[int(c)] for c in str(k)) for k in range(400)]
    long = [" ".join(f"t{letters[k % 400]}" for k in range(300)), " ".join(f"t{letters[k % 400]}" for k in range(299)) + " tail"]
    return [(1, "Hello, World 12!\n\nsecond line"), (2, "hello world 34\nthird\n" + near[0]), (3, near[1] + "\n" + near[2] + "\n\n" + near[3]),
            (4, None), (5, ""), (6, "third\nthird\nTHIRD."), (7, "-- 12!!\n-- 12!!"), (8, long[0] + "\n" + long[1]), (9, "a b c d\nd c b a\na b c d e"), (11, "alpha bravo delta gamma\nalpha bravo of delta gamma\nthe alpha bravo delta gamma of\nsigma bravo delta gamma")]


def test_line_dedup_matches_brute_force(spark):
    docs = line_docs()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, norm string, n_lines int")
    out = dedup_lines(df, exact=True)
    assert out.columns == ["doc_id", "text", "norm", "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"] or "") for r in out.collect()}
    assert got == brute_lines(docs)
    assert sum(r[1] for r in got.values()) >= 5


def test_line_dedup_of_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b\ne f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_removed"]) for r in dedup_lines(df).collect())
    assert got == [("1", "a b\nc d", 0), ("1", "a b\nc d", 0), ("None", "None", 0), ("None", "e f", 1)]
    assert dedup_lines(df.limit(0)).count() == 0


# ---- language ----

def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = langid.fit_text_model(docs.where(~held))
    assert model[0] == ["de", "en", "es", "fr"]
    test = docs.where(held)
    got = langid.identify(test, model, ["doc_id", "lang"], "text", levels=[F.col("source")]).collect()
    assert len(got) == test.count()
    right = sum(r["lang"] == r["language"] for r in got)
    assert right >= 0.95 * len(got)
    assert sum(r["language"] is None for r in got) <= 0.03 * len(got)


def test_language_evidence_decides_where_the_text_is_silent(spark):
    model = langid.fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"))
    words = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 500").collect()}
    rows = [(i, f"<html lang='de'><p>{words['de']}</p></html>", "http://a.example.de/x") for i in range(30)]
    rows += [(100 + i, f"<html lang=fr>{words['fr']}</html>", "http://b.example.fr/") for i in range(30)]
    rows += [(200, "<html lang='de'><p>ab</p></html>", "http://a.example.de/y"), (201, "<html lang='fr'>ab</html>", "http://b.example.fr/z"),
             (202, None, None), (203, "<p>12 34</p>", "x"), (204, "", "http://a.example.de/")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("language", F.lit("zz"))
    from resemble.llm.urlparts import host_of

    host = host_of(F.col("url"))
    got = {r["page_id"]: r["language"] for r in langid.identify(
        pages, model, ["page_id"], "html", markup=True, declared=langid.declared_language(F.col("html")),
        suffix=langid.address_suffix(host), levels=[langid.domain_of(host), host]).collect()}
    assert got[0] == "de" and got[100] == "fr" and got[200] == "de" and got[201] == "fr"
    assert got[202] is None and got[203] is None and got[204] is None


def test_language_id_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "some text here", None, "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert langid.keep_identified(docs).count() == 0
    assert langid.keep_identified(docs.limit(0)).columns == docs.columns
    real = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(-1, "中文字符测试" * 30, None, "src0", 1), (-2, None, "en", None, 0), (-3, "123 !!", "en", "src1", 6)], real.schema)
    kept = langid.keep_identified(real.unionByName(noise))
    assert kept.columns == real.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {-1, -2, -3} and len(ids) >= 198


# ---- urls ----

def test_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('host', id, '.example') as key")
    listed = universe.where("pmod(xxhash64(key, 1), 7) = 0")
    cascade = Cascade(universe, listed)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != (F.expr("pmod(xxhash64(key, 1), 7) = 0")))
    assert wrong.count() == 0
    assert universe.where(Cascade(universe, universe.limit(0)).contains(F.col("key"))).count() == 0
    assert universe.where(~Cascade(universe, universe).contains(F.col("key"))).count() == 0


@pytest.mark.parametrize("max_keys", [1_000_000, 1])
def test_url_verdicts(spark, monkeypatch, max_keys):
    import resemble.llm.urlfilter as module

    monkeypatch.setattr(module, "MAX_KEYS", max_keys)
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org", "http://example.org/en/12#a", "http://notexample.org/es/", "http://org/x", "ftp://x.com/fr/",
            "http://x.com/de/://y", "http://bad.net/a", "http://bad.net?q", None, "nothing", "://h", "http://bad.com/fr/a", "http://good.net/\n/x", "http://bad2.net"]
    listed = spark.createDataFrame([("bad.net",), ("bad.com",), ("bad2.net",), (None,), ("bad.net",)], "key string")
    got = [tuple(r) for r in judge_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id int, url string, host string"), listed, rules)
           .orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"),
                   ("notexample.org", "/es/", "org/", "allow"), ("org", "/x", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/://y", "com/de/", "block"),
                   ("bad.net", "/a", None, "block"), ("bad.net", "", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
                   ("bad.com", "/fr/a", "com/fr/", "allow"), ("good.net", "/\n/x", None, "allow"), ("bad2.net", "", None, "block")]
    assert judge_urls(spark.createDataFrame([], "page_id int, url string"), listed, rules).count() == 0


# ---- chat ----

def test_every_speaker_is_the_assistant_once(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "Ann B", "hi <|im_end|>"), (1, 2, "assistant", "yo"), (1, 2, "assistant", "yo"), (1, 3, None, None), (None, 0, "x", "alone"), (2, 0, "system", "only")]
    out = rotate(spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, name string")).collect()
    seen = {}
    for r in out:
        seen.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(seen) == {(1, "Ann B"), (1, "assistant"), (1, "unknown"), (None, "x")}
    ann = sorted(seen[1, "Ann B"], key=lambda r: (r["turn"], r["segment"]))
    assert [r["segment"] for r in ann] == [
        "<|im_start|>system\nbe kind<|im_end|>\n", "<|im_start|>assistant\nhi <| im_end|><|im_end|>\n", "<|im_start|>user name=assistant\nyo<|im_end|>\n",
        "<|im_start|>user name=assistant\nyo<|im_end|>\n", "<|im_start|>user name=unknown\n<|im_end|>\n"]
    assert [r["segment"][r["mask_start"]:r["mask_end"]] for r in ann] == ["", "hi <| im_end|><|im_end|>", "", "", ""]
    other = [r for r in seen[1, "assistant"] if r["turn"] == 1]
    assert other[0]["segment"] == "<|im_start|>user name=Ann_B\nhi <| im_end|><|im_end|>\n"
    assert rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- sketches ----

def brute_sketch(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
    if len(h) >= 5:
        s = []
        for i in range(len(h) - 4):
            x = 42
            for k in range(5):
                x = xxhash.xxh64(h[i + k].to_bytes(8, "little"), seed=x).intdigest()
            s.append(x)
    else:
        s = [xxhash.xxh64(" ".join(w).encode(), seed=42).intdigest()] if w else []
    # with none below the threshold the least one stays, by its upper 63 bits
    kept = {x for x in s if x >> 61 == 0} or {x for x in s if x >> 1 == min(y >> 1 for y in s)}
    return kept


def as_text(s):
    return ",".join(f"{x:x}" for x in sorted(s, key=signed))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bucket_rows", [2_000, 7])
def test_fingerprints_match_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", bucket_rows)
    docs = [(r["doc_id"], r["text"][:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    docs = docs[:37] + [(1000, None), (1001, "One two THREE"), (1002, "é" * 7), (2000, "")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, n_chars string").repartition(5)
    got = {r["doc_id"]: tuple(r) for r in sketch.fingerprints(df).collect()}
    ordered = sorted(((i, t or "") for i, t in docs), reverse=True)
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        a, b, c = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        assert got[i] == (i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(a), as_text(b), like(a, b), like(a, c)), i


def test_fingerprints_of_one_row_repeats_and_null_ids(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = sketch.fingerprints(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d"[:7]).hexdigest()
    assert sketch.fingerprints(one.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "p q"), (None, None)], "doc_id long, text string")
    got = sketch.fingerprints(many).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_sketches_merge_and_estimate_containment(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 1500)))], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(sketch.containment(F.col("sb"), F.col("sa")).alias("c"), (sketch.merged(F.col("sa"), F.col("sb")) == F.col("sa")).alias("same"),
                  F.size("sa").alias("n")).first()
    assert r["c"] == 1.0 and r["same"] and 400 < r["n"] < 600
