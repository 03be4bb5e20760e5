"""Points are found, put in order and compared no more often than needed."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_interference_finds_the_points_once(spark, monkeypatch):
    from chalkline.queries import editing as E

    found = []
    real = E.L.timeline
    monkeypatch.setattr(E.L, "timeline", lambda *a: found.append(a) or real(*a))
    model = spark.createDataFrame([("v", 1.0, 9.0)], "video_name string, start double, end double")
    assert E.edit_commands(spark, FOLDER, model).count()
    assert len(found) == 1


def test_labels_of_points_that_are_read_once(spark):
    from chalkline.operators.learning import point_labels

    spans = [("v", 10, 20, False), ("v", 290, 610, False), ("v", 15, 30, True), ("v", 700, 701, True), ("w", 5, 9, True)]
    notes = spark.createDataFrame(spans, "video_name string, start int, end int, is_interference boolean")
    points = spark.range(0, 3000).selectExpr("elt(cast(id % 3 as int) + 1, 'v', 'w', 'x') as video_name", "id", "cast(id div 3 as double) as time")
    got = point_labels(points, notes)
    for r in got.collect():
        own = [x for x in spans if x[0] == r.video_name]
        topics, bad = ([x for x in own if x[3] == kind] for kind in (False, True))
        inside = lambda xs: any(a <= r.time <= b for _, a, b, _ in xs)
        assert r.boundary == any(abs(r.time - e) <= 3 for x in topics for e in x[1:3])
        assert r.interference == (inside(bad) or (bool(topics) and not inside(topics)))
    assert got.count() == 3000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3000") == 1


def test_places_in_trees_need_no_other_index_type(spark):
    from chalkline.operators import forests as O

    r = np.random.default_rng(2)
    x, f, b = r.integers(0, 33, (500, 4)).astype(np.uint8), r.integers(0, 4, 7), r.integers(0, 32, 7).astype(np.uint8)
    b[2] = O.ALL_LEFT
    want = []
    for row in x:
        node = 0
        for _ in range(3):
            node = 2 * node + 1 + int(row[f[node]] > b[node])
        want.append(node)
    got = O._walk(x.ravel(), np.arange(500) * 4, f, b, 3)
    assert got.tolist() == want and got.dtype == np.intp


def test_shares_are_sought_only_of_features_with_many_values(spark, monkeypatch):
    from chalkline.operators import forests as O

    sought = []
    real = F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda *a: sought.append(a) or real(*a))
    rows = spark.range(3000).selectExpr("cast(id % 2 as int) as g", "id % 7 as few", "id % 40 as more", "id as many")
    got = O._edges(rows, "g", ["few", "more", "many"])
    assert len(sought) == 1
    assert got[0][0] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(got[1][1]) == 20 - 1 and len(got[1][2]) == 32


def test_words_are_sought_only_where_the_text_changes(spark):
    from chalkline.operators.features import point_features

    texts = ["a b", "a b", "b c", "", "", "学习 a", "习学 a"]
    points = spark.createDataFrame([("v", i, float(i), True, 0.1, 0, "", False, t, "x", 0.5, False) for i, t in enumerate(texts)],
        "video_name string, id long, time double, present boolean, motion double, slide_idx int, ppt_text string, slide boolean, speech_text string, speaker string, confidence double, silent boolean")
    f = point_features(points)
    got = [r.text_similarity for r in f.orderBy("id").collect()]
    assert got == [1.0, 1.0, pytest.approx(1 / 3), 0.0, 1.0, 0.0, 1.0]
    plan = f._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = plan[next(i for i, x in enumerate(plan) if "Window" in x) :]
    assert not any("regexp_extract_all" in x for x in below)


@pytest.mark.parametrize("ids", [1, 50, 5000])
def test_only_the_last_number_drawn_is_put_in_order(spark, monkeypatch, ids):
    from chalkline.operators import features as P

    rows = spark.range(5000).selectExpr("id as row", f"id % {ids} as id", "cast(id % 9 = 0 as int) as label").cache()
    want = {(k, n): {r.row for r in P.drawn(rows, ["label"], ["row", "id"]).where(f"label = {k} and _rank <= {n}").collect()} for k, n in ((0, 1), (0, 777), (1, 0), (1, 100), (1, 9999))}
    monkeypatch.setattr(P, "drawn", None)
    for (k, n), mine in want.items():
        got = P.first_drawn(rows, "label", {k: n}, ["row", "id"], "in").collect()
        assert len(got) == 5000 and {r.row for r in got if r["in"]} == mine
    assert P.held_out(rows, "label", ["row", "id"]).where("held_out").count() == 889 + 112
    assert P.balanced(rows, "label", ["row", "id"]).count() == 556 + 3 * 556
