"""Forests grown over rows spread over tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from chalkline.operators import learning as M
from chalkline.operators.features import FEATURES
from chalkline.operators.forests import best_splits


def _points(spark, n=600):
    r = random.Random(3)
    rows = []
    for i in range(n):
        x = [round(r.random(), 3) if c in ("motion", "confidence") else r.randint(0, 1) for c in FEATURES]
        x = [float(v) for v in x]
        rows.append((f"v{i % 5}", i, int(x[1] > 0.6 or (x[3] < 0.2 and x[4] == 1)), *x))
    return spark.createDataFrame(rows, "video_name string, id long, hit int, " + ", ".join(f"{c} double" for c in FEATURES))


def _scores(rows, model):
    return {r.id: r.score for r in M.ensemble_scores(rows, [model], ["id"]).collect()}


def test_a_forest_does_not_depend_on_how_rows_are_spread(spark):
    rows = _points(spark)
    one = _scores(rows, M.train_forest(rows.coalesce(1), "hit", 12))
    many = _scores(rows, M.train_forest(rows.repartition(7, "id"), "hit", 12))
    assert one == many and len(one) == 600


def test_a_forest_knows_what_it_was_shown_and_is_read_as_written(spark, tmp_path):
    rows = _points(spark)
    model = M.train_forest(rows, "hit", 40)
    got = _scores(rows, model)
    truth = {r.id: r.hit for r in rows.collect()}
    assert sum((got[i] > 0.5) == bool(truth[i]) for i in truth) > 0.95 * len(truth)
    path = M.save_model(spark, model, str(tmp_path), "all", "hit")
    assert _scores(rows, M.load_models(spark, [path, str(tmp_path / "absent")])[0]) == got


def test_each_group_has_its_own_forest(spark):
    rows = _points(spark).withColumn("half", (F.col("id") % 2).cast("int"))
    both = M.train_forests(rows, "hit", "half", 6)
    assert sorted(both) == [0, 1]
    assert _scores(rows, both[1]) == _scores(rows, M.train_forests(rows.where("half = 1"), "hit", "half", 6)[1])
    # one class, or one row of it
    few = rows.where("half = 0 or hit = 0").unionByName(rows.where("half = 1 and hit = 1").limit(1))
    assert sorted(M.train_forests(few, "hit", "half", 6)) == [0]


def test_splits_are_those_of_brute_force():
    r = np.random.default_rng(5)
    w = np.array([1.0, 2.5])
    gini = lambda c: 0.0 if not c.sum() else (c * w).sum() * (1 - (((c * w) / (c * w).sum()) ** 2).sum())
    split = 0
    for _ in range(60):
        sizes, n = r.integers(1, 5, (1, 3)), r.integers(2, 9)
        y = r.integers(0, 2, n)
        x = [r.integers(0, s, n) for s in sizes[0]]
        counts = np.concatenate([np.bincount(2 * v + y, minlength=2 * s) for v, s in zip(x, sizes[0])])
        f, b, left, right = (v[0] for v in best_splits(counts, sizes, w))
        count = lambda rows: np.bincount(y[rows], minlength=2)
        gains = {(k, i): gini(count(y >= 0)) - gini(count(v <= i)) - gini(count(v > i)) for k, v in enumerate(x) for i in range(v.max())}
        best = max(gains.values(), default=0)
        if best < 1e-9:
            assert f == -1 and (left == count(y >= 0)).all() and not right.any()
        else:
            split += 1
            assert abs(gains[f, b] - best) < 1e-9
            assert (left == count(x[f] <= b)).all() and (right == count(x[f] > b)).all()
    assert split > 30
