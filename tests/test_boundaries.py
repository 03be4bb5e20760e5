"""Folds over candidates against the plain walk over a recording."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators.boundaries import normalize_boundaries, thinned


def _plain(rows, reach, strict, replace):
    kept = []
    for x in sorted(rows):
        far = not kept or (x[0] - kept[-1][0] > reach if strict else x[0] - kept[-1][0] >= reach)
        if far:
            kept.append(x)
        elif replace and x[2] > kept[-1][2]:
            kept[-1] = x
    return kept


@pytest.mark.parametrize(("reach", "strict", "replace"), [(22.5, True, True), (45.0, False, False), (30.0, False, True)])
def test_thinned_equals_the_plain_walk(spark, reach, strict, replace):
    rnd = random.Random(int(reach))
    # one recording with a candidate every few seconds for hours, so that no gap ever ends a chain; one sparse; one at the edges of hours
    rows = [("dense", round(t * 7.3, 2), t % 2, rnd.choice([0.1, 0.5, 0.5, 0.9])) for t in range(2500)]
    rows += [("sparse", float(rnd.randrange(200_000)), 0, rnd.random()) for _ in range(200)]
    rows += [("edge", float(3600 * h + d), 0, rnd.choice([0.2, 0.4, 0.8])) for h in range(1, 6) for d in (-40, -20, -10, -1, 0, 1, 15, 29, 30, 44)]
    df = spark.createDataFrame(list(dict.fromkeys(rows)) + [(None, 1.0, 0, 1.0), ("dense", None, 0, 1.0)], "k string, time double, rank int, score double")
    got = {}
    for r in thinned(df, "k", reach, strict, replace).collect():
        got.setdefault(r.k, []).append((r.time, r["rank"], r.score))
    for k in ("dense", "sparse", "edge"):
        assert sorted(got[k]) == _plain({x[1:] for x in rows if x[0] == k}, reach, strict, replace), k
    assert thinned(df.where("false"), "k", reach).count() == 0


def test_normalised_bounds(spark):
    bounds = spark.createDataFrame([("v", t) for t in (10.0, 54.99, 55.0, 100.0, 1300.0, 2600.0)], "k string, time double")
    ends = spark.createDataFrame([("v", 10.0, 2700.0)], "k string, t_start double, t_end double")
    got = [r.time for r in normalize_boundaries(bounds, ends, "k").orderBy("pos").collect()]
    assert got == [10.0, 55.0, 100.0, 1300.0, 1950.0, 2600.0, 2700.0]


def test_groups_stay_whole_after_a_join_by_their_keys(spark):
    from chalkline.operators.boundaries import _each_group

    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c, None) for c in changed}
    for c, v in changed.items():
        spark.conf.set(c, v)
    try:
        # the join becomes a broadcast while it runs, and its shuffle is then read where it was written
        rows = spark.range(0, 400, 1, 4).selectExpr("concat('v', id % 5) as k", "id div 200 as shard", "id")
        starts = rows.groupBy("k", "shard").agg(F.min("id").alias("first"))
        got = _each_group(rows.join(starts, ["k", "shard"]), ["k", "shard"], ["id"], lambda g, x: [(*g, len(x))], "k string, shard long, n long").collect()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted(tuple(r) for r in got) == [(f"v{i}", s, 40) for i in range(5) for s in (0, 1)]
