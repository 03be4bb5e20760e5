"""What goes by recording and shard reads points that are spread and put in order once."""

import os
import random

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    r, data = random.Random(3), []
    for v, step, n, change in (("a", 300.0, 300, 0.3), ("b", 1.0, 8000, 0.01), ("c", 5000.0, 60, 0.3), ("d", 1.0, 1, 0.3), ("e", 0.5, 3, 0.3)):
        f, t = False, 0.0
        for i in range(n):
            f ^= r.random() < change
            t += step * r.choice([0, 1, 1, 2])
            data.append((v, t, i, f))
    return spark.createDataFrame(data, "video_name string, time double, id long, f boolean").cache(), data


def by_recording(data):
    own = {}
    for v, t, i, f in data:
        own.setdefault(v, []).append((t, i, f))
    return {v: sorted(rows) for v, rows in own.items()}


def test_runs_are_found_within_shards(spark, points, monkeypatch):
    from chalkline.operators import islands as I
    from chalkline.operators.alignment import ordered

    df, data = points
    want = []
    for v, rows in by_recording(data).items():
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i][2] != rows[i - 1][2]), len(rows)]
        want += [(v, rows[a][0], rows[b - 1][0], b - a, rows[b][0] if b < len(rows) else None) for a, b in zip(cuts, cuts[1:]) if rows[a][2]]
    monkeypatch.setattr(I, "sharded_scan", None)
    for given in (df, ordered(df, "video_name")):
        got = [(r.video_name, r.start, r["last"], r.n, r.next_time) for r in I.flag_islands(given, "video_name", F.col("f")).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    for gap in (1.5, 300.0, 6000.0):
        want = []
        for v, rows in by_recording(data).items():
            t = sorted({x[0] for x in rows})
            cuts = [0, *(i for i in range(1, len(t)) if t[i] - t[i - 1] > gap), len(t)]
            want += [(v, t[a], t[b - 1], b - a) for a, b in zip(cuts, cuts[1:])]
        got = [(r.video_name, r.start, r["last"], r.n) for r in I.gap_islands(df.select("video_name", "time").distinct(), "video_name", "time", gap).collect()]
        assert sorted(got) == sorted(want)


def test_ordered_points_are_not_moved_again(spark, points):
    from pyspark.sql import Window

    from chalkline.operators.alignment import ordered

    rows = ordered(points[0], "video_name")
    seen = rows.withColumn("was", F.lag("f").over(Window.partitionBy("video_name", "_shard").orderBy("time", "id")))
    assert rows.count() == points[0].count() and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()


def test_features_of_ordered_points(spark, points, monkeypatch):
    from chalkline.operators import features as P
    from chalkline.operators.alignment import ordered

    f = points[0].selectExpr("video_name", "id", "time", "f as present", "id % 11 / 10 as motion", "cast(id % 5 as int) as slide_idx", "concat('x ', id div 3) as ppt_text", "f as slide",
        "concat('w', id div 2, ' b') as speech_text", "if(f, 't', 's') as speaker", "id % 7 / 10 as confidence", "id % 3 = 0 as silent")
    want = P.point_features(f)
    monkeypatch.setattr(P, "numbered", None)
    got = P.point_features(ordered(f, "video_name")).drop("_shard")
    assert got.count() == want.count() and not want.exceptAll(got).count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["forest_final_index", "forest_detect_interference", "forest_media_commands"])
def test_forests_and_rules_find_the_points_once(spark, monkeypatch, name):
    from chalkline.queries import editing as E
    from chalkline.queries import models as Q

    found = []
    real = E.L.timeline
    monkeypatch.setattr(E.L, "timeline", lambda *a: found.append(a) or real(*a))
    monkeypatch.setattr(Q, "forest_ranges", lambda s, d: E.L.points(s, d).where("silent").select("video_name", F.col("time").alias("start"), (F.col("time") + 9).alias("end")))
    assert E.FOREST[name](spark, FOLDER).count()
    assert len(found) == 1


def test_topics_are_looked_up_by_shard(spark, monkeypatch):
    from chalkline.operators.alignment import ordered
    from chalkline.queries import joins as J

    t = spark.range(0, 9000).selectExpr("elt(cast(id % 3 as int) + 1, 'v', 'w', 'x') as video_name", "id", "cast(id div 3 as double) * 2.5 as time")
    topics = [("v", 1, 10.0, 20.0), ("v", 2, 3590.0, 3605.0), ("v", 3, 3605.0, 3700.0), ("w", 4, 0.0, 7400.0)]
    monkeypatch.setattr(J.L, "knowledge", lambda s, d: spark.createDataFrame(topics, "video_name string, id long, start double, end double"))
    monkeypatch.setattr(J.A, "as_of", None)
    got = J.with_topic_flag(spark, FOLDER, ordered(t, "video_name")).collect()
    assert len(got) == 9000
    assert all(r.inside == any(r.video_name == v and a <= r.time <= b for v, _, a, b in topics) for r in got)


def test_draws_are_counted_by_thousands_first(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from chalkline.operators import features as P

    plans = []
    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    rows = spark.range(30_000).selectExpr("id", "cast(id % 9 = 0 as int) as label")
    assert P.balanced(rows, "label", ["id"]).count() == 3334 * 4
    assert "FLOOR" in plans[1].upper()
