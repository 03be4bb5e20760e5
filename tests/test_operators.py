"""Operators against plain Python on small rows, with nulls, ties, repeats, clashing names and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import boundaries as B
from chalkline.operators import islands as I
from chalkline.operators.alignment import as_of, numbered
from chalkline.operators.fuzzy import best_terms
from chalkline.operators.periods import merge_intervals, periods_and_gaps
from chalkline.operators.regular_grid import to_grid, windows_touched
from chalkline.operators.speakers import smooth_labels
from chalkline.operators.versions import latest_version
from chalkline.plans.scan import sharded_scan


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def merged(iv):
    out = []
    for a, b in sorted(iv):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_periods_and_gaps(spark, seed):
    rnd = random.Random(seed)
    iv = {k: [(a := rnd.randrange(0, 40_000_000, 10), a + rnd.choice([10, 5000, 60_000, 3_600_000, 20_000_000 if rnd.random() < 0.05 else 100])) for _ in range(n)] for k, n in (("a", 60), ("b", 200), ("c", 1))}
    iv["a"] += [(3_600_000, 7_200_000), (7_200_000, 7_300_000), (0, 3_600_000)]
    data = [(k, a / 1000, b / 1000, 1) if rnd.random() < 0.5 else (k, b / 1000, a / 1000, 1) for k, v in iv.items() for a, b in v]
    data += data[:20] + [(None, 1.0, 2.0, 1), ("a", None, 2.0, 1), ("a", 5.0, 5.0, 1), ("a", float("nan"), 9.0, 1), ("a", 3.0, float("inf"), 1)]
    df = spark.createDataFrame(data, "k string, start double, end double, shard int")
    want = {k: merged([(min(x), max(x)) for x in v]) for k, v in iv.items()}
    assert rows(merge_intervals(df, ["k"]), "k", "from_ms", "to_ms") == sorted((k, a, b) for k, v in want.items() for a, b in v)
    gaps = sorted((k, "gap", x[1], y[0]) for k, v in want.items() for x, y in zip(v, v[1:]) if y[0] - x[1] <= 1_800_000)
    got = periods_and_gaps(df, ["k"])
    assert rows(got.where("kind = 'gap'"), "k", "kind", "from_ms", "to_ms") == gaps
    assert merge_intervals(df.where("false"), ["k"]).count() == 0


def test_grid_fills_only_inside_sessions(spark):
    rnd = random.Random(5)
    data, usable = [], {}
    for k in ("a", "b"):
        t = 0.0
        for _ in range(300):
            t += rnd.choice([3.0, 8.0, 45.0, 400.0, 2500.0 if rnd.random() < 0.2 else 5.0])
            v = rnd.choice([0.1, 0.5, 1.0, 0.0])
            data.append((k, t, v, "x"))
            usable.setdefault(k, []).append((t, v))
    bad = [("a", None, 0.5, ""), ("a", 7.0, None, ""), ("a", 7.0, float("nan"), ""), ("a", 7.0, 1.01, ""), ("a", 7.0, -0.1, ""), (None, 7.0, 0.5, "")]
    df = spark.createDataFrame(data + bad, "k string, time double, v double, value string")
    got = to_grid(df, "k", "time", "v")
    want = []
    for k, pts in usable.items():
        for (t0, _), (t1, _) in zip(pts, pts[1:]):
            if t1 - t0 <= 1800:
                want += [(k, w) for w in range(math.floor(t0 / 10) + 1, math.floor(t1 / 10))]
    assert rows(got.where("is_missing"), "k", "window_no") == sorted(want)
    full = {}
    for k, pts in usable.items():
        for t, v in pts:
            full.setdefault((k, math.floor(t / 10)), []).append(v)
    assert [(a, b, round(c, 6)) for a, b, c in rows(got.where("not is_missing"), "k", "window_no", "value")] == sorted((k, w, round(sum(x) / len(x), 6)) for (k, w), x in full.items())
    assert to_grid(df.where("false"), "k", "time", "v").count() == 0


def test_windows_touched(spark):
    df = spark.createDataFrame([("a", 5.0, 25.0), ("a", 30.0, None), ("a", None, 3.0), ("b", 9000.0, 5.0)], "k string, start double, end double")
    got = rows(windows_touched(df, "k", "start", "end"), "k", "window_no")
    assert got == [("a", 0), ("a", 1), ("a", 2), ("a", 3)] + [("b", i) for i in range(0, 901)]


def test_sharded_scan(spark):
    rnd = random.Random(1)
    data = [(k, i, rnd.choice([None, rnd.randrange(100)])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int").withColumn("s", F.floor(F.col("i") / 7))
    got = sharded_scan(df, ["k"], "s", ["i"], {"b": ("before", F.col("v")), "a": ("after", F.col("v")), "m": ("max_before", F.col("v")), "t": ("sum", F.coalesce("v", F.lit(0)))})
    for k, i, b, a, m, t in rows(got, "k", "i", "b", "a", "m", "t"):
        mine = [v for kk, j, v in data if kk == k]
        before = [v for v in mine[:i] if v is not None]
        after = [v for v in mine[i + 1 :] if v is not None]
        assert (b, a, m) == (before[-1] if before else None, after[0] if after else None, max(before, default=None))
        assert t == sum(v or 0 for v in mine[: i + 1])


def test_latest_version(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "new", 2), (2, "x", None), (None, "y", 3), (3, "b", 4), (3, "a", 4)], "id int, v string, ingested_at int")
    assert rows(latest_version(df, "id", ["v"]), "id", "v") == [(1, "new"), (2, "x"), (3, "b")]


def test_as_of_falls_back_to_the_first(spark):
    p = spark.createDataFrame([("a", float(t), t) for t in range(0, 8000, 500)] + [("b", 1.0, 1)], "video_name string, time double, i int")
    e = spark.createDataFrame([("a", 700.0, 1), ("a", 700.0, 2), ("a", 5000.0, 3), ("a", None, 4)], "video_name string, at double, id int")
    got = {(k, i): x and x.id for k, i, x in ((r.video_name, r.i, r.e) for r in as_of(p, {"e": (e, "at", ["at", "id"])}).collect())}
    assert got[("b", 1)] is None
    assert all(x == (3 if i >= 5000 else 2 if i >= 700 else 1) for (k, i), x in got.items() if k == "a")


def test_islands(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i * 700.0, i, bool(f)) for i, f in enumerate(flags)], "video_name string, time double, id int, f boolean")
    got = I.flag_islands(df, "video_name", F.col("f"))
    assert [(a / 700, b / 700, n, x and x / 700) for a, b, n, x in rows(got, "start", "last", "n", "next_time")] == [(1, 2, 2, 3), (4, 4, 1, 5), (7, 9, 3, None)]
    u = I.union_intervals(spark.createDataFrame([("a", 0.0, 5.0, 1), ("a", 5.0, 6.0, 2), ("a", 1.0, 2.0, 3), ("a", 8.0, 9.0, 4)], "video_name string, start double, end double, id int"), "video_name", ["start", "end", "id"], ())
    assert rows(u, "start", "end", "n") == [(0.0, 6.0, 3), (8.0, 9.0, 1)]


def spec_merge(c):
    out = []
    for t, r, s in sorted(c):
        if not out or t - out[-1][0] > 22.5:
            out.append((t, r, s))
        elif s > out[-1][2]:
            out[-1] = (t, r, s)
    return out


def spec_normal(bounds, t0, t1):
    half_up = lambda x: math.floor(x * 100 + 0.5 + 1e-7) / 100
    f = [half_up(t0)]
    for t in sorted(bounds):
        dt = t - f[-1]
        if dt < 45:
            continue
        if dt > 1200:
            n = int(dt / 1200)
            for _ in range(n):
                f.append(half_up(f[-1] + dt / (n + 1)))
        f.append(half_up(t))
    if abs(f[-1] - t1) >= 1e-6:
        f.append(half_up(t1))
    return f


def test_boundary_folds(spark):
    rnd = random.Random(3)
    data = {k: sorted({(round(rnd.uniform(0, 6000), 0), rnd.randrange(2), rnd.choice([0.4, 0.5, 0.8, 1.0])) for _ in range(n)}) for k, n in (("a", 150), ("b", 8), ("c", 40))}
    df = spark.createDataFrame([(k, *x) for k, v in data.items() for x in v], "video_name string, time double, rank int, score double")
    got = rows(B.merge_candidates(df, "video_name"), "video_name", "time", "rank", "score")
    assert got == sorted((k, *x) for k, v in data.items() for x in spec_merge(v))
    ends = spark.createDataFrame([("a", 0.0, 6100.0), ("b", 100.0, 6100.0), ("c", 10.0, 5000.0)], "video_name string, t_start double, t_end double")
    got = B.normalize_boundaries(df, ends, "video_name").orderBy("video_name", "pos").collect()
    for k, t0, t1 in (("a", 0.0, 6100.0), ("b", 100.0, 6100.0), ("c", 10.0, 5000.0)):
        assert [r.time for r in got if r.video_name == k] == pytest.approx(spec_normal([x[0] for x in data[k]], t0, t1), abs=0.011)


def spec_smooth(labels, lengths):
    lab = list(labels)
    if len(lab) <= 2:
        return lab
    for i in range(len(lab)):
        if lengths[i] > 4:
            continue
        around = lab[max(0, i - 3) : i] + lab[i + 1 : i + 4]
        t, s = around.count(C.TEACHER), around.count(C.STUDENT)
        if len(around) >= 2 and t != s and max(t, s) >= 2:
            lab[i] = C.TEACHER if t > s else C.STUDENT
    return lab


@pytest.mark.parametrize("size", [4, 7, 5000])
def test_smooth_labels_in_blocks(spark, size):
    rnd = random.Random(size)
    data = [(k, i, float(i * 10), i * 10 + rnd.choice([1.0, 3.0, 4.0, 4.5]), rnd.choice([C.TEACHER, C.STUDENT, C.STUDENT, C.UNKNOWN])) for k, n in (("a", 60), ("b", 2), ("c", 3), ("d", 33)) for i in range(n)]
    df = spark.createDataFrame(data, "video_name string, id long, start double, end double, speaker string")
    want = []
    for k in "abcd":
        mine = [x for x in data if x[0] == k]
        want += [(k, x[1], lab) for x, lab in zip(mine, spec_smooth([x[4] for x in mine], [x[3] - x[2] for x in mine]))]
    assert rows(smooth_labels(df, "video_name", size), "video_name", "id", "speaker") == sorted(want)


def spec_post(times, points):
    m = [times[0]]
    for t, s in times[1:]:
        if t - m[-1][0] >= 30:
            m.append((t, s))
        elif s > m[-1][1]:
            m[-1] = (t, s)
    out = [m[0][0]]
    for t, _ in m[1:]:
        while t - out[-1] > 600:
            inside = [(s, -x) for x, s in points if out[-1] <= x <= t]
            cut = -max(inside)[1] if inside else round((out[-1] + t) / 2, 2)
            if cut - out[-1] < 30:
                cut = out[-1] + 30
            if t - cut < 30:
                break
            out.append(cut)
        out.append(t)
    return sorted(set(out))


def test_post_process(spark):
    rnd = random.Random(9)
    points = {k: [(float(t), rnd.choice([0.0, 0.5, 1.5])) for t in range(0, 9000, step)] for k, step in (("a", 7), ("b", 50), ("c", 5000))}
    times = {k: sorted(rnd.sample(v, min(len(v), 12))) for k, v in points.items()}
    frame = lambda d: spark.createDataFrame([(k, *x) for k, v in d.items() for x in v], "video_name string, time double, score double")
    got = rows(B.post_process(frame(times), frame(points), "video_name"), "video_name", "time")
    assert got == sorted((k, t) for k in points for t in spec_post(times[k], points[k]))


def test_numbered(spark):
    df = spark.createDataFrame([("a", i * 999.0, i) for i in range(50)], "video_name string, time double, id int")
    assert rows(numbered(df, "video_name", ["time", "id"]), "id", "idx") == [(i, i) for i in range(50)]


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        d = _step(d, i, x, b)
    return d[-1]


def _step(d, i, x, b):
    n = [i + 1]
    for j, y in enumerate(b):
        n.append(min(d[j + 1] + 1, n[j] + 1, d[j] + (x != y)))
    return n


def test_best_terms_equals_brute_force(spark):
    terms = ["神经网络图", "亚里士多德", "learning", "leaning", "图灵测试机"]
    tokens = ["神经网格图", "亚里土多德", "亚里士多", "learnin", "leasning", "learning", "图灵", "", None, "xlearning"]
    got = rows(best_terms(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(t,) for t in terms], "term string"), "token", "term"), "token", "term", "distance")
    want = []
    for a in sorted({t for t in tokens if t and t not in terms}):
        near = [(edits(a, b) / max(len(a), len(b)) + 0.05 * edits(a, b), -len(b), b) for b in terms if edits(a, b) <= 1 and edits(a, b) / max(len(a), len(b)) <= 0.22]
        if near:
            want.append((a, min(near)[2], 1))
    assert got == want


def test_text_functions(spark):
    df = spark.createDataFrame([("　教 师：",), ("Ｔｅａｃｈｅｒ",), ("s",), ("N/A",), (None,)], "x string")
    assert [r[0] for r in df.select(X.speaker_role(F.col("x"))).collect()] == [C.TEACHER, C.TEACHER, C.STUDENT, C.UNKNOWN, C.UNKNOWN]
    t = spark.createDataFrame([("1:02:03",), (" 65.5 ",), ("1:99:00",), ("",), (None,)], "x string")
    assert [r[0] for r in t.select(X.parse_seconds(F.col("x"))).collect()] == [3723.0, 65.5, None, None, None]
    n = spark.createDataFrame([(0.0, "ab"), (None, "abcd"), (0.8, ""), (0.81, "abc"), (0.81, "abcd")], "nsp double, t string")
    assert [r[0] for r in n.select(X.keeps_speech(F.col("nsp"), F.col("t"))).collect()] == [False, True, True, False, True]
