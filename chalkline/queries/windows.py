"""Row windows, islands, turns and interval unions on the recording tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import islands as I
from chalkline.operators.alignment import SHARD_S, as_of, numbered, sharded
from chalkline.operators.features import point_features
from chalkline.operators.periods import merge_intervals
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise
from chalkline.queries._views import STRIP, with_views
from chalkline.queries.joins import with_topic_flag
from chalkline.queries.scalars import ANN, annotations, raw_annotations
from chalkline.sources import lecture as L


def features14(s, d):
    f = point_features(L.timeline(s, d))
    return f.withColumns({c: F.round(c, 6) for c in ("motion", "confidence", "prev_confidence", "roll_silence", "roll_present", "text_similarity", "rate_change", "roll_silence_ahead")})


def rolling_features(s, d):
    cols = ("roll_silence", "roll_present", "roll_silence_ahead")
    return point_features(L.timeline(s, d)).select("video_name", "id", "prev_present", "slide_delta", "speaker_change", *(F.round(c, 6).alias(c) for c in cols))


def jaccard_lag(s, d):
    return point_features(L.timeline(s, d)).select("video_name", "id", F.round("text_similarity", 6).alias("text_similarity"))


def silence_islands(s, d, least=C.CONFIG.silence_s):
    got = I.flag_islands(L.timeline(s, d), "video_name", F.col("silent"))
    return got.where(F.col("next_time") - F.col("start") >= least).select("video_name", "start", F.col("next_time").alias("end"))


def rule_a(s, d, cfg=C.CONFIG, timeline=None):
    t = with_topic_flag(s, d, timeline)
    talk = F.col("present") & ~F.col("silent") & (F.col("speaker") == C.TEACHER) & ~F.col("inside")
    got = I.flag_islands(t, "video_name", talk)
    end = F.coalesce("next_time", F.col("last") + cfg.resolution)
    return got.select("video_name", "start", end.alias("end")).where(F.col("end") - F.col("start") >= cfg.rule_a_s)


rule_a_islands = rule_a


def turns(s, d, cfg=C.CONFIG, timeline=None):
    """Turns of one known speaker: video_name, turn, speaker, start, end, texts."""
    known = ~F.col("silent") & F.col("speaker").isin(C.TEACHER, C.STUDENT)
    rows = sharded((L.timeline(s, d) if timeline is None else timeline).withColumn("known", known))
    order = ["time", "id"]
    seen = sharded_scan(rows, ["video_name"], "_shard", order, {"was": ("before", F.struct("known", "speaker", "time"))}).where("known")
    same = F.col("was.known") & (F.col("was.speaker") == F.col("speaker")) & (F.col("time") <= F.col("was.time") + cfg.resolution + cfg.eps)
    marked = seen.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("t", F.nullif(X.strip(F.col("speech_text")), F.lit("")))
    counted = sharded_scan(materialise(marked), ["video_name"], "_shard", order, {"turn": ("sum", F.col("new"))})
    said = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("time", "id", "t"))))
    texts = F.transform(F.filter(said, lambda x, i: (i == 0) | (x["t"] != said[F.greatest(i - 1, F.lit(0))]["t"])), lambda x: x["t"])
    return counted.groupBy("video_name", "turn").agg(
        F.first("speaker").alias("speaker"), F.min("time").alias("start"), (F.max("time") + cfg.resolution).alias("end"), texts.alias("texts")
    )


def speaker_turns(s, d):
    return turns(s, d).select("video_name", "speaker", "start", "end", F.array_join("texts", "|").alias("texts"))


def qa(s, d, cfg=C.CONFIG, timeline=None):
    """A teacher's turn, a student's, and a third that follows at once: hits of the cues."""
    t = materialise(turns(s, d, cfg, timeline).withColumn("_shard", F.floor(F.col("start") / SHARD_S)))
    me = F.struct("speaker", "start", "end", "texts")
    one = sharded_scan(t, ["video_name"], "_shard", ["start"], {"t2": ("after", me)})
    one = materialise(one)
    two = sharded_scan(one, ["video_name"], "_shard", ["start"], {"_n": ("after", F.struct("t2", "turn"))})
    pair = two.where((F.col("speaker") == C.TEACHER) & (F.col("t2.speaker") == C.STUDENT)).withColumn("t3", F.col("_n.t2"))
    third = (F.col("t3.start") <= F.col("t2.end") + cfg.resolution + cfg.eps) & (F.col("t3.end") - F.col("start") <= cfg.qa_s)
    none = F.array().cast("array<string>")
    rows = pair.withColumn("third", F.coalesce(third, F.lit(False))).withColumns({
        "stop": F.when(F.col("third"), F.col("t3.end")).otherwise(F.col("t2.end")),
        "said": F.concat("texts", F.when(F.col("third") & (F.col("t3.speaker") == C.TEACHER), F.col("t3.texts")).otherwise(none)),
        "answered": F.concat("t2.texts", F.when(F.col("third") & (F.col("t3.speaker") == C.STUDENT), F.col("t3.texts")).otherwise(none)),
    })
    cue = lambda texts, cues: F.exists(texts, lambda x: (F.length(X.strip(x)) >= cfg.qa_text) & X.any_of(x, cues))
    hit = cue("said", C.QUESTION_CUES) | cue("answered", C.ANSWER_CUES)
    return rows.where((F.col("stop") - F.col("start") <= cfg.qa_s) & hit).select("video_name", F.round("start", 2).alias("start"), F.round("stop", 2).alias("end"))


qa_pattern = qa


def ranges_of(times, cfg=C.CONFIG):
    """Stretches of the times (video_name, time; distinct) that a model marks, 5 s or longer."""
    got = I.gap_islands(times, "video_name", "time", cfg.model_gap)
    return got.where(F.col("last") - F.col("start") >= cfg.min_interference).select("video_name", "start", F.col("last").alias("end"))


def model_ranges(s, d, cfg=C.CONFIG):
    """``ranges_of`` dull points by their boundary score: a rule in place of a model, so that SQL can say it. The forests' are in ``forest_ranges``."""
    score = X.boundary_score(F.col("silent"), F.col("slide"), F.col("confidence"))
    return ranges_of(L.timeline(s, d).where(score >= 0.1).select("video_name", F.round("time", 2).alias("time")).distinct(), cfg)


def interval_union(s, d):
    """The annotated topics as disjoint intervals."""
    a = annotations(raw_annotations(s, d)).where("not is_interference")
    m = merge_intervals(a, ["video_name"])
    return m.select("video_name", F.round(F.col("from_ms") / 1000, 2).alias("start"), F.round(F.col("to_ms") / 1000, 2).alias("end"))


def slide_runs(s, d):
    """Full-screen runs of the samples: last time of a strong change in the run (else its start), page number, samples, and the last text recognised in it.

    Images are outside, so their similarity is a number made from id and place; the text at a sample is that of the latest page.
    """
    seen = as_of(L.samples(s, d), {"page": (L.slides(s, d), "time", ["time", "id", "text"])})
    text = F.when(F.col("page.time") <= F.col("time"), F.nullif(X.strip("page.text"), F.lit("")))
    rows = numbered(seen.withColumn("text", text).drop("page"), "video_name", ["time", "id"]).withColumn("similar", (F.col("id") * 37 + F.col("idx")) % 100 / 100.0)
    change = F.max(F.when(F.col("similar") < C.CONFIG.slide_change, F.struct("time", "similar")))
    last = F.max_by("text", F.when(F.col("text").isNotNull(), F.struct("time", "id")))
    got = I.flag_islands(rows, "video_name", F.col("full_screen"), values=(change.alias("c"), last.alias("text")))
    placed = got.withColumn("_shard", F.floor(F.col("start") / SHARD_S))
    counted = sharded_scan(placed, ["video_name"], "_shard", ["start"], {"slide_idx": ("sum", F.lit(1))})
    return counted.select("video_name", "slide_idx", F.coalesce("c.time", "start").alias("time"), F.coalesce("c.similar", F.lit(0.0)).alias("ssim"), "n", F.coalesce("text", F.lit("")).alias("text"))


_W = "OVER (PARTITION BY video_name ORDER BY time, id{frame})"
_B, _A = (_W.format(frame=f" ROWS BETWEEN {x}") for x in ("10 PRECEDING AND CURRENT ROW", "CURRENT ROW AND 10 FOLLOWING"))
_P = lambda c: f"coalesce(lag({c}) {_W.format(frame='')}, {c})"
_SET = "list_distinct(regexp_extract_all(lower({x}), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9_]+'))"
_FEAT = f"""f AS (SELECT video_name, id, time, CAST(present AS INT) AS present, motion, CAST(slide AS INT) AS slide, confidence, CAST(silent AS INT) AS silent,
  CAST({_P('present')} AS INT) AS prev_present, {_P('confidence')} AS prev_confidence, CAST(slide_idx <> {_P('slide_idx')} AS INT) AS slide_delta,
  avg(CAST(silent AS INT)) {_B} AS roll_silence, avg(CAST(present AS INT)) {_B} AS roll_present,
  speech_text || ' ' || ppt_text AS t0, {_P('speech_text')} || ' ' || {_P('ppt_text')} AS t1, CAST(abs(length(speech_text) - length({_P('speech_text')})) AS DOUBLE) AS rate_change,
  CAST(speaker <> {_P('speaker')} AS INT) AS speaker_change, avg(CAST(silent AS INT)) {_A} AS roll_silence_ahead FROM tl),
j AS (SELECT *, {_SET.format(x='t0')} AS a, {_SET.format(x='t1')} AS b FROM f),
ft AS (SELECT * EXCLUDE (t0, t1, a, b), CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS text_similarity FROM j)"""
FEATURES_SQL = _FEAT
_ISL = lambda src, cond: f"""i0 AS (SELECT *, ({cond}) AS f FROM {src}),
i1 AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY time, id) - row_number() OVER (PARTITION BY video_name, f ORDER BY time, id) AS k,
  min(CASE WHEN NOT f THEN time END) OVER (PARTITION BY video_name ORDER BY time, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM i0),
isl AS (SELECT video_name, min(time) AS "start", max(time) AS last, max(nx) AS nx, count(*) AS n FROM i1 WHERE f GROUP BY video_name, k)"""  # noqa: E731
SILENCES = _ISL("tl", "silent") + """, sil AS (SELECT video_name, "start", nx AS "end" FROM isl WHERE nx - "start" >= {least})"""
_TALK = _ISL("(SELECT tl.*, EXISTS (SELECT 1 FROM kno k WHERE k.video_name = tl.video_name AND tl.time BETWEEN k.\"start\" AND k.\"end\") AS inside FROM tl)", "present AND NOT silent AND speaker = '教师' AND NOT inside")
RULE_A = _TALK + """, ra AS (SELECT * FROM (SELECT video_name, "start", coalesce(nx, last + 1.0) AS "end" FROM isl) WHERE "end" - "start" >= 10)"""
TURNS = """t0 AS (SELECT *, NOT silent AND speaker IN ('教师', '学生') AS known, trim(speech_text, ' \t\n\r　') AS t FROM tl),
t1 AS (SELECT *, lag(known) OVER w AS wk, lag(speaker) OVER w AS ws, lag(time) OVER w AS wt FROM t0 WINDOW w AS (PARTITION BY video_name ORDER BY time, id)),
t2 AS (SELECT *, sum(CASE WHEN wk AND ws = speaker AND time <= wt + 1 + 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY video_name ORDER BY time, id) AS turn FROM t1 WHERE known),
t3 AS (SELECT *, lag(t) OVER (PARTITION BY video_name, turn ORDER BY time, id) AS lt FROM t2 WHERE t <> ''),
tx AS (SELECT video_name, turn, list(t ORDER BY time, id) AS texts FROM t3 WHERE lt IS NULL OR lt <> t GROUP BY video_name, turn),
tu AS (SELECT a.*, coalesce(tx.texts, []) AS texts FROM (SELECT video_name, turn, any_value(speaker) AS speaker, min(time) AS "start", max(time) + 1.0 AS "end" FROM t2 GROUP BY video_name, turn) a LEFT JOIN tx USING (video_name, turn))"""
_CUE = lambda col, cues: "len(list_filter(" + col + ", lambda x: length(x) >= 3 AND (" + " OR ".join(f"contains(x, '{c}')" for c in cues) + "))) > 0"
QA = TURNS + f""", q1 AS (SELECT *, lead(speaker) OVER w AS s2, lead("end") OVER w AS e2, lead(texts) OVER w AS x2, lead(speaker, 2) OVER w AS s3, lead("start", 2) OVER w AS b3, lead("end", 2) OVER w AS e3, lead(texts, 2) OVER w AS x3
  FROM tu WINDOW w AS (PARTITION BY video_name ORDER BY "start")),
q2 AS (SELECT *, coalesce(b3 <= e2 + 1 + 1e-6 AND e3 - "start" <= 600, false) AS third FROM q1 WHERE speaker = '教师' AND s2 = '学生'),
q3 AS (SELECT *, CASE WHEN third THEN e3 ELSE e2 END AS stop, list_concat(texts, CASE WHEN third AND s3 = '教师' THEN x3 ELSE [] END) AS said, list_concat(x2, CASE WHEN third AND s3 = '学生' THEN x3 ELSE [] END) AS answered FROM q2),
qa AS (SELECT video_name, round("start", 2) AS "start", round(stop, 2) AS "end" FROM q3 WHERE stop - "start" <= 600 AND ({_CUE('said', C.QUESTION_CUES)} OR {_CUE('answered', C.ANSWER_CUES)}))"""
_ROUND = ("motion", "confidence", "prev_confidence", "roll_silence", "roll_present", "text_similarity", "rate_change", "roll_silence_ahead")

_SQL = {
    "features14": with_views(f", {_FEAT} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _ROUND)}) FROM ft", "tl"),
    "rolling_features": with_views(f", {_FEAT} SELECT video_name, id, prev_present, slide_delta, speaker_change, round(roll_silence, 6) AS roll_silence, round(roll_present, 6) AS roll_present, round(roll_silence_ahead, 6) AS roll_silence_ahead FROM ft", "tl"),
    "jaccard_lag": with_views(f", {_FEAT} SELECT video_name, id, round(text_similarity, 6) AS text_similarity FROM ft", "tl"),
    "silence_islands": with_views(f", {SILENCES.format(least=15)} SELECT * FROM sil", "tl"),
    "rule_a_islands": with_views(f", {RULE_A} SELECT * FROM ra", "tl", "kno"),
    "speaker_turns": with_views(f""", {TURNS} SELECT video_name, speaker, "start", "end", array_to_string(texts, '|') AS texts FROM tu""", "tl"),
    "qa_pattern": with_views(f", {QA} SELECT * FROM qa", "tl"),
    "model_ranges": with_views(""", p AS (SELECT DISTINCT video_name, round(time, 2) AS time FROM tl WHERE CASE WHEN silent THEN 1.5 ELSE 0 END + CASE WHEN slide THEN 1.0 ELSE 0 END + greatest(0, 1 - confidence) * 0.5 >= 0.1),
r AS (SELECT *, sum(CASE WHEN time - b <= 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY video_name ORDER BY time) AS k FROM (SELECT *, lag(time) OVER (PARTITION BY video_name ORDER BY time) AS b FROM p))
SELECT * FROM (SELECT video_name, min(time) AS "start", max(time) AS "end" FROM r GROUP BY video_name, k) WHERE "end" - "start" >= 5""", "tl"),
    "interval_union": f"""WITH a AS ({ANN}), m AS (SELECT *, max("end") OVER (PARTITION BY video_name ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a WHERE NOT is_interference),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_name ORDER BY "start", "end", id) AS n FROM m)
SELECT video_name, CAST(min("start") AS DOUBLE) AS "start", CAST(max("end") AS DOUBLE) AS "end" FROM g GROUP BY video_name, n""",
    "slide_runs": with_views(f", pg AS (SELECT video_name, time, id, {STRIP.format(c='text')} AS text FROM sli QUALIFY row_number() OVER (PARTITION BY video_name, time ORDER BY id DESC) = 1), n0 AS (SELECT sam.*, nullif(pg.text, '') AS text, row_number() OVER (PARTITION BY sam.video_name ORDER BY sam.time, sam.id) - 1 AS idx FROM sam ASOF LEFT JOIN pg ON pg.video_name = sam.video_name AND sam.time >= pg.time), " + _ISL("n0", "full_screen").replace("count(*) AS n", "count(*) AS n, arg_max(text, CASE WHEN text IS NOT NULL THEN struct_pack(t := time, i := id) END) AS text, max(CASE WHEN (id * 37 + idx) % 100 < 70 THEN struct_pack(t := time, v := (id * 37 + idx) % 100 / 100.0) END) AS c") + """
SELECT video_name, row_number() OVER (PARTITION BY video_name ORDER BY "start") AS slide_idx, coalesce(c.t, "start") AS time, coalesce(c.v, 0) AS ssim, n, coalesce(text, '') AS text FROM isl""", "sam", "sli"),
}


def queries() -> dict:
    return {n: globals()[n] for n in _SQL}


def oracle_sql() -> dict[str, str]:
    return _SQL


