"""Stages, detections kept over frames, reasons in words."""

import random

from pyspark.sql import functions as F

from chalkline.operators import vision
from chalkline.operators.regular_grid import to_grid
from chalkline.plans.pipeline import run_stages
from chalkline.queries.editing import percent, seconds


def test_stages_stop_at_the_first_that_fails(spark, tmp_path):
    stages = [("one", lambda: spark.range(3)), ("two", lambda: spark.sql("select raise_error('no')")), ("three", lambda: spark.range(1))]
    got = [tuple(r)[:4] for r in run_stages(spark, stages, str(tmp_path)).orderBy("step").collect()]
    assert got == [(1, "one", "ok", 3), (2, "two", "error", None)]
    assert [r.name for r in run_stages(spark, stages, str(tmp_path), 3).collect()] == ["three"]


def test_cached_detection_equals_a_loop(spark):
    rnd = random.Random(5)
    rows = [(k, i, float(i * 700), rnd.random() < 0.7, rnd.random() < 0.5) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id int, time double, need boolean, person boolean")
    got = {(r.k, r.id): r.detected for r in vision.cached_detection(df, "k", ["time", "id"], F.col("need"), F.col("person")).collect()}
    for k in "ab":
        last = None
        for idx, (_, i, _, need, person) in enumerate(r for r in rows if r[0] == k):
            last = (person if last is None or idx % 2 == 0 else last) if need else None
            assert got[k, i] == bool(last)


def test_crop(spark):
    df = spark.sql("select transform(sequence(0, 3), y -> transform(sequence(0, 4), x -> y * 10 + x)) as p")
    assert df.select(vision.crop(F.col("p"), 0.2, 0.5, 0.8, 1.0)).first()[0] == [[21, 22, 23], [31, 32, 33]]


def test_percent_and_seconds(spark):
    df = spark.createDataFrame([(0.125, 15.0), (0.555, 0.05), (1.0, 3600.04)], "a double, b double")
    assert [tuple(r) for r in df.select(percent(F.col("a")), seconds(F.col("b"))).collect()] == [("13%", "15.0"), ("56%", "0.1"), ("100%", "3600.0")]


def test_grid_means_do_not_depend_on_order(spark):
    values = [0.0601, 0.0713, 0.0902, 0.0768, 0.0745, 0.0746, 0.0744, 0.0748]
    for k in range(3):
        random.Random(k).shuffle(values)
        df = spark.createDataFrame([("v", float(i), v) for i, v in enumerate(values)] + [("v", 45.0, 0.5)], "k string, t double, v double")
        got = [(r.window_no, r.value, r.is_missing) for r in to_grid(df, "k", "t", "v").orderBy("window_no").collect()]
        assert got[0] == (0, 0.074588, False) and got[-1] == (4, 0.5, False)
        assert [x[1] for x in got[1:4]] == [0.180941, 0.287294, 0.393647]
