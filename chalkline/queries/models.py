"""Labels, trained models, sources, sinks and streams on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators import learning as M
from chalkline.operators import stats as S
from chalkline.operators.boundaries import normalize_boundaries, post_process
from chalkline.operators.features import FEATURES, balanced, held_out, point_features
from chalkline.plans.pipeline import run_stages
from chalkline.plans.session import materialise, shared_folder
from chalkline.queries._views import with_views
from chalkline.queries.scalars import ANN, annotations, raw_annotations
from chalkline.queries.windows import ranges_of
from chalkline.sources import files
from chalkline.sources import lecture as L
from chalkline.streaming import sessions as ST


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/chalkline-{uuid.uuid4().hex}"


def labels(s, d):
    return M.point_labels(L.timeline(s, d), annotations(raw_annotations(s, d)))


def _examples(s, d, label):
    """The points with features and labels; ``held_out`` for a fifth of each class of ``label``."""
    x = materialise(M.point_labels(point_features(L.points(s, d)), annotations(raw_annotations(s, d)), keep=FEATURES))
    return materialise(held_out(x, label, ["video_name", "id"]))


def _models(rows, label, trees):
    """One forest for each half of the recordings."""
    half = F.pmod(F.xxhash64("video_name"), F.lit(2))
    return list(M.train_forests(rows.withColumn("_half", half.cast("int")), label, "_half", trees).values())


def train_rf(s, d, trees=200):
    """Held-out report of the interference forest."""
    rows = _examples(s, d, "interference")
    train = balanced(rows.where("not held_out"), "interference", ["video_name", "id"])
    model = M.train_forest(train, "interference", trees)
    test = rows.where("held_out")
    guess = M.ensemble_scores(test, [model], ["interference"]).select(F.col("interference").alias("truth"), (F.col("score") > 0.5).cast("int").alias("guess")) if model else test.select(F.col("interference").alias("truth"), F.lit(0).alias("guess"))
    return S.classification_report(guess, "truth", "guess")


def ensemble_predict(s, d, trees=200):
    """Boundaries that two averaged forests and the rules predict, post-processed."""
    rows = _examples(s, d, "boundary")
    models = _models(rows.where("not held_out"), "boundary", trees)
    t = L.timeline(s, d)
    marks = materialise(M.boundary_hits(t, M.ensemble_scores(rows, models, ["video_name", "id"]))) if models else t.where("boundary").select("video_name", "time")
    score = F.round(X.boundary_score(F.col("silent"), F.col("slide"), F.col("confidence")), 6)
    points = t.groupBy("video_name", "time").agg(F.max_by(score, "id").alias("score"))
    return post_process(marks.join(points, ["video_name", "time"]).select("video_name", "time", "score"), points, "video_name")


def evaluate(s, d, trees=200):
    """Report of the averaged interference forests at the threshold 0.5, on the held-out points."""
    rows = _examples(s, d, "interference")
    models = _models(materialise(balanced(rows.where("not held_out"), "interference", ["video_name", "id"])), "interference", trees)
    test = rows.where("held_out")
    if not models:
        return S.classification_report(test.select(F.col("interference").alias("truth"), F.lit(0).alias("guess")), "truth", "guess")
    guess = M.ensemble_scores(test, models, ["interference"]).select(F.col("interference").alias("truth"), (F.col("score") >= 0.5).cast("int").alias("guess"))
    return S.classification_report(guess, "truth", "guess")


def predict_interference(s, d, trees=200, threshold=0.5):
    """Times of all points, held out or not, that the averaged interference forests score at the threshold or above; without a forest none."""
    rows = _examples(s, d, "interference")
    models = _models(materialise(balanced(rows.where("not held_out"), "interference", ["video_name", "id"])), "interference", trees)
    if not models:
        return rows.where("false").select("video_name", "time")
    hit = M.ensemble_scores(rows, models, ["video_name", "id", "time"]).where(F.col("score") >= threshold)
    return hit.select("video_name", F.round("time", 2).alias("time")).distinct()


def forest_ranges(s, d, trees=200):
    """Stretches of interference that the forests mark."""
    return ranges_of(materialise(predict_interference(s, d, trees)))


def refine_boundaries(s, d, trees=200):
    """Rule boundaries of each recording with those of the forests that lie inside, normalised again."""
    from chalkline.queries.topics import _ends, normalize_boundaries as rules

    ends = materialise(_ends(s, d))
    inside = M.bounds_inside(ensemble_predict(s, d, trees), ends)
    return normalize_boundaries(rules(s, d).select("video_name", "time").unionByName(inside), ends, "video_name")


def model_store(s, d, trees=200):
    """Forests written for two halves of the recordings and read again; points that both agree on."""
    rows = _examples(s, d, "boundary")
    to = _scratch(s)
    paths = [M.save_model(s, m, to, f"half{k}", "boundary") for k, m in enumerate(_models(rows, "boundary", trees))]
    scores = M.ensemble_scores(rows, M.load_models(s, paths), ["video_name", "id"])
    return scores.groupBy("video_name").agg(F.count_if(F.col("score") >= 0.5).alias("likely"), F.count("*").alias("points"))


def json_roundtrip(s, d):
    """The timeline written as JSON documents and read again."""
    to = _scratch(s)
    files.write_timeline_documents(L.timeline(s, d), to)
    return files.read_timeline_documents(s, to)


def binary_listing(s, d):
    """Files below the data folder, by name and size."""
    return files.find_files(s, d, "*.parquet").select("stem", "output_dir", "bytes", "size_mb")


def pipeline_run(s, d):
    """The five stages over all recordings, each one's table written, with their status."""
    from chalkline.queries import editing, joins, scalars, topics

    stages = (
        ("visual", lambda: scalars.presence_cached(s, d)), ("audio", lambda: topics.smooth_labels(s, d)), ("text", lambda: topics.detect_topics(s, d)),
        ("align", lambda: joins.timeline_align(s, d)), ("fuse", lambda: editing.final_index(s, d)),
    )
    return run_stages(s, stages, _scratch(s)).select("step", "name", "status", "rows")


def _event_stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    # as a pattern, since a table may be a file or a folder
    return s.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _seconds(c):
    """Seconds of the wall clock shown, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))").alias(c)


def stream_sessions(s, d):
    """Sessions of every user of the events table, by a stream over its files."""
    stream = _event_stream(s, d)
    out = _scratch(s)
    ST.run_to_table(ST.sessions(stream, "user_id", "ts", "12 hours"), out, out + "-checkpoint")
    return s.read.parquet(out).select("user_id", _seconds("start"), _seconds("end"), "n")


def stream_samples(s, d):
    stream = _event_stream(s, d)
    out = _scratch(s)
    ST.run_to_table(ST.sampled(stream, "event_type", "ts", "value"), out, out + "-checkpoint")
    return s.read.parquet(out).select("event_type", _seconds("start"), "n", F.round("mean", 4).alias("mean"))


_SQL = {
    "labels": with_views(f""", a AS ({ANN}), hk AS (SELECT DISTINCT video_name FROM a WHERE NOT is_interference)
SELECT tl.video_name, tl.id, tl.time, CAST(EXISTS (SELECT 1 FROM a WHERE a.video_name = tl.video_name AND NOT is_interference AND (abs(tl.time - a."start") <= 3 OR abs(tl.time - a."end") <= 3)) AS INT) AS boundary,
  CAST(EXISTS (SELECT 1 FROM a WHERE a.video_name = tl.video_name AND is_interference AND tl.time BETWEEN a."start" AND a."end")
    OR (tl.video_name IN (SELECT video_name FROM hk) AND NOT EXISTS (SELECT 1 FROM a WHERE a.video_name = tl.video_name AND NOT is_interference AND tl.time BETWEEN a."start" AND a."end")) AS INT) AS interference FROM tl""", "tl"),
    "json_roundtrip": with_views(" SELECT video_name, time, id, silent, speaker FROM tl", "tl"),
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS "start", CAST(floor(epoch(max(ts))) AS BIGINT) AS "end", count(*) AS n FROM r GROUP BY user_id, k""",
    "stream_samples": """SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS "start", count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2""",
}


def queries() -> dict:
    return {n: globals()[n] for n in (*_SQL, "binary_listing", "pipeline_run", "train_rf", "ensemble_predict", "evaluate", "predict_interference", "forest_ranges", "refine_boundaries", "model_store")}


def oracle_sql() -> dict[str, str]:
    return _SQL


