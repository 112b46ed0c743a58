"""Row numbers, consecutive rows and ranks by ranges, against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from resemble.operators.order import competition_rank, consecutive, row_numbers
from resemble.session import broadcast_within, within_bytes


def test_row_numbers_run_through_all_ranges(spark):
    rnd = random.Random(1)
    keys = [rnd.randrange(300) for _ in range(2_000)]
    got = row_numbers(spark.createDataFrame([(k,) for k in keys], "k int").repartition(7), [F.col("k")]).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 2_001)) and [r.k for r in got] == sorted(keys)
    assert row_numbers(spark.createDataFrame([], "k int"), [F.col("k")]).count() == 0


def test_consecutive_rows_jump_gaps_and_keep_to_their_group(spark):
    rows = [("a", 1, "p"), ("a", 5, "q"), ("a", 9, "r"), ("b", 2, "s"), ("c", 7, "t"), ("c", 7, "u")]
    df = spark.createDataFrame(rows, "g string, turn int, text string")
    got = consecutive(df, ["turn", "text"], {"text": ["x", "y"], "turn": ["turn"]}, "g")
    assert sorted((r.g, r.turn, r.x, r.y) for r in got.collect()) == [("a", 1, "p", "q"), ("a", 5, "q", "r"), ("c", 7, "t", "u")]
    ids = spark.createDataFrame([(i,) for i in (3, 10, 11, 40)], "id long")
    trip = consecutive(ids, ["id"], {"id": ["a", "b", "c"]})
    assert sorted(map(tuple, trip.select("a", "b", "c").collect())) == [(3, 10, 11), (10, 11, 40)]


@pytest.mark.parametrize("rounded", [True, False])
def test_competition_rank(spark, rounded):
    rnd = random.Random(2)
    rows = [(rnd.choice("xyz"), rnd.choice([rnd.random(), 0.25, 0.75]), i) for i in range(900)]
    got = competition_rank(spark.createDataFrame(rows, "p string, s double, i int"), ["p"], "s", rounded=rounded).collect()
    assert {(r.i, r["rank"]) for r in got} == {(i, 1 + sum(q == p and t > s for q, t, _ in rows)) for p, s, i in rows}


def test_only_small_tables_are_broadcast(spark):
    df = spark.createDataFrame([(1, "x" * 1_000), (2, None)], "k int, t string")
    assert within_bytes(df, 2_000) and not within_bytes(df, 900)
    plan = spark.range(3).join(broadcast_within(df, 900), F.col("id") == F.col("k"))._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()
