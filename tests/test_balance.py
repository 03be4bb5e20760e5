"""Draws of rows: exact numbers, the same each time."""

import pytest

from chalkline.operators.features import balanced, drawn, held_out


@pytest.mark.parametrize("ids", [1, 997, 40_000])
def test_three_negatives_a_positive(spark, ids):
    df = spark.range(40_000).selectExpr(f"id % {ids} as id", "id as row", "cast(id in (5, 20005) as int) as label")
    got = balanced(df, "label", ["row", "id"]).collect()
    assert sum(r.label for r in got) == 2
    assert len({r.row for r in got}) == len(got) == 8
    assert {r.row for r in balanced(df, "label", ["row", "id"]).collect()} == {r.row for r in got}


def test_one_class_stays_whole(spark):
    df = spark.range(10).selectExpr("id", "0 as label")
    assert balanced(df, "label", ["id"]).count() == 10 and balanced(df.where("false"), "label", ["id"]).count() == 0


def test_a_fifth_of_each_class_is_held_out(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 50 = 0 as int) as label")
    got = held_out(df, "label", ["id"]).groupBy("label").agg({"*": "count"}).count(), held_out(df, "label", ["id"]).where("held_out").groupBy("label").count().collect()
    assert got[0] == 2 and {r["label"]: r["count"] for r in got[1]} == {0: 196, 1: 4}
    single = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    assert held_out(single, "label", ["id"]).where("held_out").count() == 1
    ranks = drawn(df, ["label"], ["id"]).where("label = 1").select("_rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(1, 21))
