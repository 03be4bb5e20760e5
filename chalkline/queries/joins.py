"""Alignment and interval joins on the recording tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import alignment as A
from chalkline.operators.islands import union_intervals
from chalkline.plans.session import materialise
from chalkline.queries._views import KEEP, with_views
from chalkline.queries.scalars import ANN, annotations, raw_annotations
from chalkline.sources import lecture as L
from chalkline.sources.tables import table


def duration_infer(s, d):
    """Length of each recording: the end of its speech, or of its samples where that is later."""
    return _durations(L.segments(s, d), L.samples(s, d))


def _durations(segments, samples):
    a = segments.groupBy("video_name").agg(F.max("end").alias("x"))
    b = samples.groupBy("video_name").agg(F.max("time").alias("x"))
    return a.unionByName(b).groupBy("video_name").agg(F.max("x").alias("duration"))


def asof_latest(s, d):
    """For each second of each recording its sample and page."""
    dur = materialise(duration_infer(s, d))
    last = lambda t: A.latest_on_grid(t, "video_name", "time", "id", F.col("id"), dur, "duration")
    got = A.on_grid(dur, "video_name", "duration", {"sample_id": last(L.samples(s, d)), "content_id": last(L.slides(s, d))})
    return got.select("video_name", "i", "sample_id", "content_id")


def stab_enclosing(s, d):
    dur = materialise(duration_infer(s, d))
    got = A.on_grid(dur, "video_name", "duration", {"hit": A.enclosing_on_grid(L.segments(s, d), "video_name", F.col("id"), dur, "duration")})
    return got.select("video_name", "i", F.col("hit.v").alias("seg_id"))


def band_flags(s, d):
    return A.near_points(L.slides(s, d), "video_name", "time", 1.0, 1.0)


def contain_join(s, d):
    """Every segment with every topic that it lies wholly in."""
    return A.contained(L.segments(s, d), L.knowledge(s, d), "video_name").select("id", F.col("outer_id").alias("ks_id"))


def _points_in_segment(s, d, timeline=None):
    k = L.knowledge(s, d)
    lo, hi = F.ceil("start"), F.floor("end")
    pts = k.where(hi >= lo).select("video_name", F.col("id").alias("ks_id"), "start", "end", F.explode(F.sequence(F.floor(lo / 60), F.floor(hi / 60))).alias("b"))
    t = (L.timeline(s, d) if timeline is None else timeline).select("video_name", "time", "present", "silent", F.floor(F.col("time") / 60).alias("b"))
    return pts.join(t, ["video_name", "b"]).where("time >= start and time <= end")


def points_in_segment(s, d):
    return _points_in_segment(s, d).groupBy("ks_id").agg(
        F.count("*").alias("n"), F.round(F.avg((~F.col("present")).cast("int")), 6).alias("absent_ratio"), F.round(F.avg(F.col("silent").cast("int")), 6).alias("silence_ratio")
    )


def _topics(s, d):
    return union_intervals(L.knowledge(s, d), "video_name", ["start", "end", "id"], ())


def with_topic_flag(s, d, timeline=None):
    """Timeline points with ``inside``: whether a topic holds them. The topics are merged first, so one as-of join tells, or a look-up where points have a ``_shard``."""
    u = _topics(s, d)
    if timeline is not None and "_shard" in timeline.columns:
        found = A.with_spans(timeline, u.select("video_name", F.lit("k").alias("_kind"), F.col("start").alias("a"), F.col("end").alias("b")), "video_name", "k")
        return found.withColumn("inside", F.coalesce(F.exists("_k", lambda r: F.col("time").between(r["a"], r["b"])), F.lit(False))).drop("_k")
    got = A.as_of(L.timeline(s, d) if timeline is None else timeline, {"k": (u, "start", ["start", "end"])})
    return got.withColumn("inside", F.coalesce((F.col("time") >= F.col("k.start")) & (F.col("time") <= F.col("k.end")), F.lit(False))).drop("k")


def outside_segments(s, d):
    return with_topic_flag(s, d).where("not inside").select("video_name", "id")


def overlap(topics, others, least, bucket=300):
    """``topics`` with the first of ``others`` (start, ord) that covers more than ``least`` of them: ord, ratio."""
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    k = spread(topics.select("video_name", "id", "start", "end"))
    o = spread(others.select("video_name", "ord", F.col("start").alias("start"), F.col("end").alias("end"))).withColumnRenamed("start", "s").withColumnRenamed("end", "e")
    ratio = (F.least("end", "e") - F.greatest("start", "s")) / F.greatest(F.col("end") - F.col("start"), F.lit(0.001))
    pairs = k.join(o, ["video_name", "_b"]).withColumn("ratio", ratio).where(F.col("ratio") > least)
    return pairs.groupBy("video_name", "id").agg(F.min(F.struct("s", "ord", "ratio")).alias("x")).select("video_name", "id", "x.ord", "x.ratio")


def label_band(s, d):
    """Grid points no more than 3 s from the start or end of an annotated topic."""
    a = annotations(raw_annotations(s, d)).where("not is_interference")
    ends = a.select("video_name", F.explode(F.array("start", "end")).alias("time")).distinct().withColumn("time", F.col("time").cast("double"))
    return A.near_points(ends, "video_name", "time", 1.0, 3.0, inclusive=True)


def nearest_valid(s, d, least=0.4):
    """Speaker and probability of each segment, taken from the nearest one of ``least`` seconds or more by position where it is shorter."""
    g = A.numbered(L.segments(s, d), "video_name", ["start", "id"], "start").withColumn("valid", F.round(F.col("end") - F.col("start"), 6) >= least)
    v = g.where("valid").select("video_name", F.col("idx").cast("double").alias("at"), F.col("id").alias("from_id"), "speaker", "teacher_prob")
    got = A.as_of(g.select("video_name", F.col("idx").cast("double").alias("time"), "id"), {"v": (v, "at", ["at", "from_id", "speaker", "teacher_prob"])}, both=True)
    b, a = F.col("v"), F.col("v_after")
    best = F.when(a.isNull() | (F.col("time") - b["at"] <= a["at"] - F.col("time")), F.coalesce(b, a)).otherwise(a)
    return got.select("id", best["from_id"].alias("from_id"), best["speaker"].alias("speaker"), best["teacher_prob"].alias("teacher_prob"))


def artefact_left_join(s, d):
    audio = L.segments(s, d).groupBy("video_name").agg(F.count("*").alias("segments"))
    text = L.knowledge(s, d).groupBy("video_name").agg(F.count("*").alias("topics"))
    visual = L.samples(s, d).groupBy("video_name").agg(F.count("*").alias("samples"))
    return audio.join(text, "video_name").join(visual, "video_name", "left").select("video_name", "segments", "topics", F.coalesce("samples", F.lit(0)).alias("samples"))


def pair_annotations(s, d, folders=("/archive/a/", "/archive/b/")):
    """For each file stem of the index, the path that goes first: by extension, then by folder in the order given, then by path."""
    p = table(s, d, "multimodal_index").where("video_path is not null").select(
        "video_path", F.regexp_extract("video_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("video_path", r"\.([^./]*)$", 1).alias("ext")
    ).distinct()
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("mp4", "avi", "mov", "mkv"))), F.lower("ext")), F.lit(0))
    folder = F.coalesce(*(F.when(F.col("video_path").startswith(x), i) for i, x in enumerate(folders)), F.lit(len(folders)))
    order = F.struct(F.when(rank == 0, 9).otherwise(rank).alias("e"), folder.alias("f"), "video_path")
    return p.groupBy("stem").agg(F.min(order)["video_path"].alias("video_path"))


def exact_time(s, d):
    """Slides with the timeline point at their very time, to hundredths, the last of several; a slide without one has its time alone."""
    p = L.timeline(s, d).groupBy("video_name", F.round("time", 2).alias("t")).agg(F.max("id").alias("point_id"))
    return L.slides(s, d).select("video_name", "id", F.round("time", 2).alias("t")).join(p, ["video_name", "t"], "left").select("id", "t", "point_id")


def timeline_align(s, d, cfg=C.CONFIG):
    """The aligned table: one row a second and recording, with state, slide, speech and topic."""
    g, k, slides = (materialise(t) for t in (L.segments(s, d), L.knowledge(s, d), L.slides(s, d)))  # each read several times
    dur = materialise(_durations(g, L.samples(s, d)))
    short = lambda c: F.substring(c, 1, cfg.timeline_text).alias(c)
    said = F.struct(short("text"), "speaker", F.round("confidence", 4).alias("confidence"), (~X.keeps_speech(F.col("nsp"), F.col("text"), cfg)).alias("silent"))
    state = F.struct("in_podium", F.round("motion_ratio", 4).alias("motion_ratio"))
    flag = lambda t: A.near_points(t, "video_name", "time", cfg.resolution, cfg.resolution).withColumn("x", F.lit(True))
    on = ("video_name", "duration")
    got = A.on_grid(dur, *on, {
        "state": A.latest_on_grid(L.samples(s, d), "video_name", "time", "id", state, dur, "duration", cfg.resolution),
        "page": A.latest_on_grid(slides, "video_name", "time", "id", F.struct("slide_idx", short("text")), dur, "duration", cfg.resolution),
        "said": A.enclosing_on_grid(g, "video_name", said, dur, "duration", cfg.resolution),
        "topic": A.enclosing_on_grid(k, "video_name", F.struct("id", "title"), dur, "duration", cfg.resolution),
        "turned": flag(slides),
        "bound": flag(k.select("video_name", F.explode(F.array("start", "end")).alias("time"))),
    }, cfg.resolution)
    default = lambda c, v: F.coalesce(c, F.lit(v))
    return got.select(
        "video_name", "i", default("state.in_podium", True).alias("teacher_present"), default("state.motion_ratio", 0.0).alias("motion_ratio"),
        default("page.slide_idx", 0).alias("slide_idx"), default("page.text", "").alias("ppt_text"), default("turned", False).alias("is_slide_transition"),
        default("said.v.text", "").alias("speech_text"), default("said.v.speaker", "").alias("speaker"), default("said.v.confidence", 0.0).alias("speech_confidence"),
        default("said.v.silent", True).alias("is_silence"), default("topic.v.id", 0).alias("knowledge_id"), default("topic.v.title", C.UNKNOWN).alias("knowledge_title"),
        default("bound", False).alias("is_knowledge_boundary"),
    )


_DUR = """dur AS (SELECT video_name, max(x) AS duration FROM (SELECT video_name, "end" AS x FROM seg UNION ALL SELECT video_name, time FROM sam) GROUP BY video_name),
g AS (SELECT video_name, unnest(range(CAST(floor(duration) AS BIGINT) + 1)) AS i FROM dur)"""
_ASOF = lambda t, at, out: f"""SELECT g.video_name, g.i, coalesce(b.{out}, f.{out}) AS {out} FROM g
  ASOF LEFT JOIN (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY video_name, {at} ORDER BY id DESC) = 1) b ON b.video_name = g.video_name AND g.i >= b.{at}
  LEFT JOIN (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY video_name ORDER BY {at}, id) = 1) f ON f.video_name = g.video_name"""  # noqa: E731
_STAB = lambda t: f"""SELECT g.video_name, g.i, coalesce(
    (SELECT arg_min(id, struct_pack(a := "start", b := id)) FROM {t} x WHERE x.video_name = g.video_name AND g.i BETWEEN x."start" AND x."end"),
    (SELECT arg_min(id, struct_pack(a := round(abs(x."start" - g.i), 6), b := x."start", c := id)) FROM {t} x WHERE x.video_name = g.video_name)) AS id FROM g"""  # noqa: E731
_TOPICS = """u AS (SELECT video_name, min("start") AS s, max("end") AS e FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_name ORDER BY "start", "end", id) AS n FROM (
    SELECT *, max("end") OVER (PARTITION BY video_name ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kno)) GROUP BY video_name, n)"""

_SQL = {
    "duration_infer": with_views(f", {_DUR} SELECT * FROM dur", "seg", "sam"),
    "asof_latest": with_views(f", {_DUR}, a AS ({_ASOF('sam', 'time', 'id')}), b AS ({_ASOF('sli', 'time', 'id')}) SELECT a.video_name, a.i, a.id AS sample_id, b.id AS content_id FROM a JOIN b USING (video_name, i)", "seg", "sam", "sli"),
    "stab_enclosing": with_views(f", {_DUR} SELECT video_name, i, id AS seg_id FROM ({_STAB('seg')})", "seg", "sam"),
    "band_flags": with_views(", c AS (SELECT video_name, time, unnest([CAST(floor(time) AS BIGINT) - 1, CAST(floor(time) AS BIGINT), CAST(floor(time) AS BIGINT) + 1]) AS i FROM sli) SELECT DISTINCT video_name, i FROM c WHERE abs(i - time) < 1 AND i >= 0", "sli"),
    "contain_join": with_views(""" SELECT seg.id, kno.id AS ks_id FROM seg JOIN kno ON kno.video_name = seg.video_name AND seg."start" >= kno."start" AND seg."end" <= kno."end" """, "seg", "kno"),
    "points_in_segment": with_views(""" SELECT kno.id AS ks_id, count(*) AS n, round(avg(CAST(NOT present AS INT)), 6) AS absent_ratio, round(avg(CAST(silent AS INT)), 6) AS silence_ratio
FROM kno JOIN tl ON tl.video_name = kno.video_name AND tl.time BETWEEN "start" AND "end" GROUP BY kno.id""", "kno", "tl"),
    "outside_segments": with_views(""" SELECT video_name, id FROM tl WHERE NOT EXISTS (SELECT 1 FROM kno k WHERE k.video_name = tl.video_name AND tl.time BETWEEN k."start" AND k."end")""", "kno", "tl"),
    "label_band": f"""WITH a AS ({ANN}), b AS (SELECT DISTINCT video_name, unnest(["start", "end"]) AS t FROM a WHERE NOT is_interference)
SELECT DISTINCT video_name, i FROM (SELECT video_name, unnest(range(t - 3, t + 4)) AS i FROM b) WHERE i >= 0""",
    "nearest_valid": with_views(""", n AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY "start", id) AS i, round("end" - "start", 6) >= 0.4 AS valid FROM seg),
m AS (SELECT a.id, (SELECT arg_min(b.id, struct_pack(d := abs(b.i - a.i), i := b.i)) FROM n b WHERE b.video_name = a.video_name AND b.valid) AS from_id FROM n a)
SELECT m.id, from_id, n.speaker, n.teacher_prob FROM m LEFT JOIN n ON n.id = from_id""", "seg"),
    "artefact_left_join": with_views(""", a AS (SELECT video_name, count(*) AS segments FROM seg GROUP BY 1), t AS (SELECT video_name, count(*) AS topics FROM kno GROUP BY 1), v AS (SELECT video_name, count(*) AS samples FROM sam GROUP BY 1)
SELECT video_name, segments, topics, coalesce(samples, 0) AS samples FROM a JOIN t USING (video_name) LEFT JOIN v USING (video_name)""", "seg", "kno", "sam"),
    "pair_annotations": r"""WITH p AS (SELECT DISTINCT video_path, regexp_extract(video_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, lower(regexp_extract(video_path, '\.([^./]*)$', 1)) AS ext FROM multimodal_index WHERE video_path IS NOT NULL)
SELECT stem, video_path FROM p QUALIFY row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN 'mp4' THEN 1 WHEN 'avi' THEN 2 WHEN 'mov' THEN 3 WHEN 'mkv' THEN 4 ELSE 9 END, CASE WHEN starts_with(video_path, '/archive/a/') THEN 0 WHEN starts_with(video_path, '/archive/b/') THEN 1 ELSE 2 END, video_path) = 1""",
    "exact_time": with_views(" SELECT sli.id, round(sli.time, 2) AS t, max(tl.id) AS point_id FROM sli LEFT JOIN tl ON tl.video_name = sli.video_name AND round(tl.time, 2) = round(sli.time, 2) GROUP BY sli.id, round(sli.time, 2)", "sli", "tl"),
    "timeline_align": with_views(f""", {_DUR}, st AS ({_ASOF('sam', 'time', 'id')}), pg AS ({_ASOF('sli', 'time', 'id')}), sg AS ({_STAB('seg')}), kn AS ({_STAB('kno')}),
q AS (SELECT *, NOT {KEEP} AS silent FROM seg),
tr AS (SELECT DISTINCT video_name, unnest([CAST(floor(time) AS BIGINT), CAST(ceil(time) AS BIGINT)]) AS i FROM sli),
bd AS (SELECT DISTINCT video_name, unnest([CAST(floor("start") AS BIGINT), CAST(ceil("start") AS BIGINT), CAST(floor("end") AS BIGINT), CAST(ceil("end") AS BIGINT)]) AS i FROM kno)
SELECT g.video_name, g.i, coalesce(sam.in_podium, true) AS teacher_present, round(coalesce(sam.motion_ratio, 0), 4) AS motion_ratio, coalesce(sli.slide_idx, 0) AS slide_idx,
  substring(coalesce(sli.text, ''), 1, 60) AS ppt_text, tr.i IS NOT NULL AS is_slide_transition, substring(coalesce(q.text, ''), 1, 60) AS speech_text, coalesce(q.speaker, '') AS speaker,
  round(coalesce(q.confidence, 0), 4) AS speech_confidence, coalesce(q.silent, true) AS is_silence, coalesce(kno.id, 0) AS knowledge_id, coalesce(kno.title, '未知') AS knowledge_title, bd.i IS NOT NULL AS is_knowledge_boundary
FROM g LEFT JOIN st USING (video_name, i) LEFT JOIN sam ON sam.id = st.id LEFT JOIN pg USING (video_name, i) LEFT JOIN sli ON sli.id = pg.id
LEFT JOIN sg USING (video_name, i) LEFT JOIN q ON q.id = sg.id LEFT JOIN kn USING (video_name, i) LEFT JOIN kno ON kno.id = kn.id
LEFT JOIN tr USING (video_name, i) LEFT JOIN bd USING (video_name, i)""", "seg", "sam", "sli", "kno"),
}


def queries() -> dict:
    return {n: globals()[n] for n in _SQL}


def oracle_sql() -> dict[str, str]:
    return _SQL
