"""Joins by time against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import alignment as A


def _tables(spark, seed):
    rnd = random.Random(seed)
    lengths = {"a": 20.5, "b": 7500.0, "c": 3.0, "d": 0.0}
    events = [(rnd.choice("abcx"), i, round(rnd.uniform(-5, 30 if i % 3 else 9000), rnd.choice([0, 2]))) for i in range(120)]
    events += [("a", 500, 4.0), ("a", 501, 4.0), (None, 502, 1.0), ("a", 503, None)]
    spans = [(k, i, t, round(t + rnd.choice([0, 0.4, 3, 40, 4000]), 2)) for k, i, t in events if k and t is not None]
    return lengths, events, spans


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_lookups_equal_brute_force(spark, seed):
    lengths, events, spans = _tables(spark, seed)
    dur = spark.createDataFrame(list(lengths.items()), "k string, d double")
    e = spark.createDataFrame(events, "k string, id long, time double").withColumn("extra", F.lit(1))
    s = spark.createDataFrame(spans, "k string, id long, start double, end double")
    got = A.on_grid(dur, "k", "d", {
        "x": A.latest_on_grid(e, "k", "time", "id", F.col("id"), dur, "d"), "y": A.enclosing_on_grid(s, "k", F.col("id"), dur, "d")
    }).select("k", "i", "x", "y.v").collect()
    assert len(got) == sum(int(n) + 1 for n in lengths.values())
    for k, i, x, y in got:
        own = sorted((t, n) for kk, n, t in events if kk == k and t is not None)
        before = [z for z in own if z[0] <= i]
        assert x == (before[-1][1] if before else own[0][1] if own else None), (k, i)
        mine = [z for z in spans if z[0] == k]
        held = sorted((a, n) for _, n, a, b in mine if a <= i <= b)
        near = min(((round(abs(a - i), 3), a, n) for _, n, a, _ in mine), default=(0, 0, None))
        assert y == (held[0][1] if held else near[2]), (k, i)


def test_grid_of_empty_tables(spark):
    dur = spark.createDataFrame([("a", 2.0), (None, 3.0)], "k string, d double")
    e = spark.createDataFrame([], "k string, id long, time double, start double, end double")
    got = A.on_grid(dur, "k", "d", {"x": A.latest_on_grid(e, "k", "time", "id", F.col("id"), dur, "d"), "y": A.enclosing_on_grid(e, "k", F.col("id"), dur, "d")})
    assert [(r.k, r.i, r.x, r.y) for r in got.orderBy("i").collect()] == [("a", i, None, None) for i in range(3)]


def test_contained_equals_brute_force(spark):
    rnd = random.Random(3)
    make = lambda n, longest: [(rnd.choice("ab"), i, a, round(a + rnd.uniform(0, longest), 2)) for i in range(n) for a in [round(rnd.uniform(0, 2000), 2)]]
    inner, outer = make(150, 90) + [("a", 900, None, 3.0)], make(60, 1500) + [("b", 901, 50.0, 40.0)]
    cols = "k string, id long, start double, end double"
    got = A.contained(spark.createDataFrame(inner, cols), spark.createDataFrame(outer, cols), "k")
    want = sorted((k, i, j) for k, i, a, b in inner for q, j, c, d in outer if k == q and a is not None and c <= a and b <= d)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
