"""Queries fed by trained forests, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_forest_interference_has_the_points_the_forests_mark(spark, monkeypatch):
    import __spark_entry__ as entry
    from chalkline.plans.session import materialise
    from chalkline.queries import models as Q

    forests = Q.predict_interference
    marks = []

    def few_trees(s, d, trees=200):
        assert trees == 200
        marks.append(materialise(forests(s, d, 10)))
        return marks[-1]

    monkeypatch.setattr(Q, "predict_interference", few_trees)
    found = entry.queries()["forest_detect_interference"](spark, FOLDER).where("sources like '%model%'").collect()
    times = {}
    for r in marks[0].collect():
        times.setdefault(r.video_name, []).append(r.time)
    want = []
    for k, v in times.items():
        v = sorted(set(v))
        cuts = [0, *(i for i in range(1, len(v)) if round(v[i] - v[i - 1], 6) > 1.5), len(v)]
        want += [(k, v[a], v[b - 1]) for a, b in zip(cuts, cuts[1:]) if v[b - 1] - v[a] >= 5]
    assert want and found
    inside = lambda a, b: a[0] == b[0] and b[1] - 0.01 <= a[1] and a[2] <= b[2] + 0.01
    got = [(r.video_name, r.start, r.end) for r in found]
    assert all(any(inside(w, g) for g in got) for w in want)
    assert all(any(inside(w, g) for w in want) for g in got)
    # a forest that knows the labels marks most labelled points and few others; a rule of dull points does not
    labels = {(r.video_name, round(r.time, 2)): r.interference for r in Q.labels(spark, FOLDER).collect()}
    hit = {(k, t) for k, v in times.items() for t in v}
    yes = {x for x, y in labels.items() if y}
    assert len(hit & yes) > 0.5 * len(yes)
    assert len(hit & yes) / len(hit) > 1.2 * len(yes) / len(labels)


@pytest.mark.parametrize("name", ["ensemble_predict", "evaluate", "refine_boundaries", "model_store", "train_rf", "predict_interference"])
def test_forests_have_all_trees(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from chalkline.queries import models as Q

    class Stop(Exception):
        pass

    def stop(rows, label, trees):
        raise Stop(trees)

    rows = spark.range(9).selectExpr("'v' as video_name", "id", "false as held_out", "cast(id < 3 as int) as boundary", "cast(id < 3 as int) as interference")
    monkeypatch.setattr(Q, "_examples", lambda s, d, label: rows)
    monkeypatch.setattr(Q, "_models", stop)
    monkeypatch.setattr(Q.M, "train_forest", stop)
    with pytest.raises(Stop) as got:
        entry.queries()[name](spark, FOLDER)
    assert got.value.args == (200,)
