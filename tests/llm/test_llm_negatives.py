"""Hard negatives against a plain computation over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from resemble.llm import negatives
from resemble.llm.negatives import hard_negatives, quantised

TYPES = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, keep=5, low=80):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
          if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, q, lab in sorted(ok, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (q, lab))
    out = []
    for a, (q, lab) in anchors.items():
        pairs = sorted((-sum(x * y for x, y in zip(q, p)), i, other) for i, p, other in ok if i != a)
        for minus, i, _ in [p for p in pairs if p[2] == lab][:positives]:
            inside = [p for p in pairs if p[2] != lab and low * -minus <= 100 * -p[0] <= 100 * -minus]
            out += [(a, i, k + 1, n, -minus, -m) for k, (m, n, _) in enumerate(inside[:keep])]
    return sorted(out)


def mined(spark, rows, parts=4, **how):
    return sorted(map(tuple, hard_negatives(quantised(spark.createDataFrame(rows, TYPES).repartition(parts)), **how).collect()))


@pytest.mark.parametrize("block,size", [(2_048, 2_048), (2, 7)])
def test_matches_all_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(negatives, "ROW_SLICE", size)
    rnd = random.Random(5)
    # few values, so that many scores tie
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rnd.randrange(3)) for i in range(420)]
    rows += [(1000, None, 1), (1001, [1.0, None, 1.0, 1.0], 1), (1002, [math.nan, 1.0, 1.0, 1.0], 1), (1003, [math.inf, 1.0, 1.0, 1.0], 1),
             (1004, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (1100, [], 1), (1101, [1.0], 2), (1005, [1.0] * 6, 0)]
    # repeated rows, also of an anchor
    rows += rows[5:9] + [rows[100], (100, [9.0, 9.0, 9.0, 9.0], 2)]
    got = mined(spark, rows, block=block)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, rows, parts=1, block=block) == got


def test_large_components_are_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) * 2.0 ** 20 for _ in range(5)], i % 2) for i in range(101)]
    assert mined(spark, rows, every=50) == brute(rows, every=50)
    a, b = 3_000_000_001, -2_999_999_999
    got = negatives._inner(negatives.np.array([[a, 1]]), negatives.np.array([[b, 7]]))
    assert got.tolist() == [[a * b + 7]]
    with pytest.raises(OverflowError):
        negatives._inner(negatives.np.array([[1 << 62]]), negatives.np.array([[4]]))


def test_empty_few_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.0], 2), (3, [0.9, 0.0], 2)]
    want = brute(rows)
    df = spark.createDataFrame(rows, TYPES).withColumns({c: F.lit("x") for c in ("id", "q", "v", "score", "anchor_id")})
    assert sorted(map(tuple, hard_negatives(quantised(df)).collect())) == want and len(want) == 2


def test_one_label_with_a_third_of_all_rows(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 0 if i % 3 == 0 else i % 11) for i in range(900)]
    assert mined(spark, rows, parts=9) == brute(rows)
