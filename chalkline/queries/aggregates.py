"""Statistics of recordings, scores and labels on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.functions.config import CONFIG
from chalkline.operators import stats as S
from chalkline.operators.features import balanced, class_weights, held_out
from chalkline.operators.vision import is_present
from chalkline.queries._views import KEEP, with_views
from chalkline.queries.joins import duration_infer
from chalkline.queries.scalars import _SQL as _SCALAR
from chalkline.sources import lecture as L
from chalkline.sources.tables import table


def visual_stats(s, d):
    a = L.samples(s, d).groupBy("video_name").agg(F.count("*").alias("samples"), F.count_if(is_present(F.col("motion_ratio"), F.col("static_person"), F.col("full_screen"))).alias("present"))
    b = L.slides(s, d).groupBy("video_name").agg(F.count("*").alias("slides"))
    return a.join(b, "video_name", "left").select("video_name", "samples", "present", F.round(F.col("present") / F.greatest("samples", F.lit(1)), 3).alias("presence_ratio"), F.coalesce("slides", F.lit(0)).alias("slides"))


def audio_stats(s, d):
    keep = X.keeps_speech(F.col("nsp"), F.col("text"))
    return L.segments(s, d).groupBy("video_name").agg(
        F.count("*").alias("segments"), F.count_if(keep).alias("valid"), F.round(F.coalesce(F.sum(F.when(keep, F.col("end") - F.col("start"))), F.lit(0.0)), 2).alias("speech_s"),
        mean_of("confidence", 4).alias("confidence"), F.count_if(F.coalesce(1 - F.col("nsp") < CONFIG.low_confidence, F.lit(False))).alias("low"),
    )


def mean_of(c, decimals):
    """The mean of a column to so many decimals, half up, of whole numbers of the last one: the same in any order of rows."""
    total, n = F.sum(F.round(F.col(c) * 10**decimals).cast("bigint")), F.count("*")
    return F.call_function("div", 2 * total + n, 2 * n) / 10**decimals


def text_stats(s, d):
    dur = F.col("end") - F.col("start")
    return L.knowledge(s, d).groupBy("video_name").agg(F.count("*").alias("topics"), F.round(F.sum(dur) / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_s"), F.round(F.sum(dur), 2).alias("total_s"))


def index_stats(s, d):
    return L.timeline(s, d).groupBy("video_name").agg(
        F.count("*").alias("points"), F.round(F.avg(F.col("present").cast("int")), 3).alias("presence_ratio"), F.round(F.avg(F.col("silent").cast("int")), 3).alias("silence_ratio"), F.count_if("slide").alias("turns")
    )


def _scored(s, d):
    return L.segments(s, d).withColumn("dur", F.col("end") - F.col("start")).withColumn("score", X.teacher_talk_score(F.col("text")))


def zscore(s, d):
    z = S.zscore(_scored(s, d), "video_name", ["dur", "score"])
    return z.select("id", F.round("z_dur", 5).alias("z_dur"), F.round("z_score", 5).alias("z_score"))


def robust_logistic(s, d):
    return S.robust_logistic(_scored(s, d), "video_name", "dur").select("id", F.round("prob", 5).alias("prob"))


def prototypes(s, d):
    """Mean direction of the vectors of each label, and each vector's cosine to its own."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("u", S.unit(F.col("v")))
    proto = S.mean_vectors(e, ["label"], "u").select("label", S.unit(F.col("mean")).alias("p"))
    return e.join(proto, "label").select("vec_id", F.round(S.cosine(F.col("v"), F.col("p")), 5).alias("similarity"))


def title_groups(s, d):
    """Topics of one title in a recording as the parts of one clip, in order of first appearance."""
    k = L.knowledge(s, d).withColumn("title", X.clean_title(F.col("title"), F.col("id")))
    g = k.groupBy("video_name", "title").agg(
        F.min(F.struct("start", "id")).alias("first"), F.count("*").alias("parts"), F.sum(F.ceil("end") - F.floor("start")).alias("duration"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("p"),
    )
    start, end = F.array_min("p.start"), F.array_max("p.end")
    a, b = X.hms_range(start, end)
    return g.select("video_name", "title", F.col("first.id").alias("first_id"), "parts", "duration", a.alias("start"), b.alias("end"))


def final_stats(s, d):
    k = L.knowledge(s, d).withColumn("ok", F.col("end") - F.col("start") >= 20)
    return k.groupBy("video_name").agg(F.count_if("ok").alias("clips"), F.count_if(~F.col("ok")).alias("removed"), F.coalesce(F.sum(F.when(F.col("ok"), F.ceil("end") - F.floor("start"))), F.lit(0)).alias("duration"))


def class_weights_query(s, d):
    t = L.timeline(s, d).select(F.col("boundary").cast("int").alias("label"))
    return class_weights(t, "label").select("label", "n", F.round("weight", 6).alias("weight"))


def classification_report(s, d):
    t = L.timeline(s, d).select(F.col("boundary").cast("int").alias("truth"), F.col("slide").cast("int").alias("guess"))
    r = S.classification_report(t, "truth", "guess")
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "weighted_f1")), "support")


def dynamic_boundary_threshold(s, d):
    r = L.timeline(s, d).groupBy("video_name").agg(F.avg(F.col("slide").cast("int")).alias("a"), F.avg(F.col("silent").cast("int")).alias("b"))
    return r.select("video_name", F.round(S.boundary_threshold(F.col("a"), F.col("b")), 4).alias("threshold"))


def thresholds(s, d, timeline=None):
    r = (L.timeline(s, d) if timeline is None else timeline).groupBy("video_name").agg(F.avg(F.col("present").cast("int")).alias("p"), F.avg(F.col("silent").cast("int")).alias("q"))
    n = L.slides(s, d).groupBy("video_name").agg(F.count("*").alias("n"))
    x = r.join(duration_infer(s, d), "video_name").join(n, "video_name", "left")
    a, b, c = S.interference_thresholds(F.round("p", 3), F.round("q", 3), F.coalesce("n", F.lit(0)) / F.greatest("duration", F.lit(1.0)))
    return x.select("video_name", a.alias("absent"), b.alias("quiet"), c.alias("seconds"))


def dynamic_interference_threshold(s, d):
    return thresholds(s, d).select("video_name", *(F.round(c, 4).alias(c) for c in ("absent", "quiet", "seconds")))


def run_summary(s, d):
    """Which stages have results for each recording of the index."""
    names = table(s, d, "multimodal_index").select("video_name").distinct()
    stages = {"visual": L.samples(s, d), "audio": L.segments(s, d), "text": L.knowledge(s, d), "align": L.timeline(s, d)}
    done = None
    for n, t in stages.items():
        one = t.select("video_name").distinct().withColumn("stage", F.lit(n))
        done = one if done is None else done.unionByName(one)
    p = done.groupBy("video_name").pivot("stage", list(stages)).count()
    return names.join(p, "video_name", "left").select("video_name", *(F.when(F.col(n).isNotNull(), "ok").otherwise("missing").alias(n) for n in stages))


def balance(s, d):
    t = L.timeline(s, d).select("video_name", "id", F.col("boundary").cast("int").alias("label"))
    return balanced(t, "label", ["video_name", "id"]).select("video_name", "id", "label")


def split_rows(s, d):
    """A fifth of the points of each class held out."""
    t = L.timeline(s, d).select("video_name", "id", F.col("boundary").cast("int").alias("label"))
    return held_out(t, "label", ["video_name", "id"]).select("video_name", "id", "label", "held_out")


_TALK = _SCALAR["teacher_talk_score"].replace("round(CASE WHEN t = '' ", "(CASE WHEN t = '' ").replace(" END, 6) AS score FROM q", " END) AS score FROM q")
_DUR = """(SELECT video_name, max(x) AS duration FROM (SELECT video_name, "end" AS x FROM seg UNION ALL SELECT video_name, time FROM sam) GROUP BY video_name)"""
_TITLE = r"coalesce(nullif(trim(regexp_replace(trim(title), '^\s*知识点\s*[0-9]+\s*[-_—:：]?\s*', '')), ''), nullif(trim(title), ''), '片段' || CAST(id + 1 AS VARCHAR))"
_HMS = "CAST({x} // 3600 AS VARCHAR) || ':' || lpad(CAST({x} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0')"
_DRAW = "(17 * 31 + id % 1000003 * 7919 + 104729) % 1000003"

_SQL = {
    "visual_stats": with_views(""", a AS (SELECT video_name, count(*) AS samples, count(*) FILTER (motion_ratio > 0.02 OR static_person OR full_screen) AS present FROM sam GROUP BY 1), b AS (SELECT video_name, count(*) AS slides FROM sli GROUP BY 1)
SELECT video_name, samples, present, round(present / greatest(samples, 1), 3) AS presence_ratio, coalesce(slides, 0) AS slides FROM a LEFT JOIN b USING (video_name)""", "sam", "sli"),
    "audio_stats": with_views(f""" SELECT video_name, count(*) AS segments, count(*) FILTER ({KEEP}) AS valid, round(coalesce(sum("end" - "start") FILTER ({KEEP}), 0), 2) AS speech_s, (2 * sum(CAST(round(confidence * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 1e4 AS confidence,
  count(*) FILTER (1 - nsp < 0.60) AS low FROM seg GROUP BY video_name""", "seg"),
    "text_stats": with_views(""" SELECT video_name, count(*) AS topics, round(avg("end" - "start"), 2) AS mean_s, round(sum("end" - "start"), 2) AS total_s FROM kno GROUP BY video_name""", "kno"),
    "index_stats": with_views(" SELECT video_name, count(*) AS points, round(avg(CAST(present AS INT)), 3) AS presence_ratio, round(avg(CAST(silent AS INT)), 3) AS silence_ratio, count(*) FILTER (slide) AS turns FROM tl GROUP BY video_name", "tl"),
    "zscore": f"""SELECT id, round(CASE WHEN stddev_pop(dur) OVER w < 1e-6 THEN 0 ELSE (dur - avg(dur) OVER w) / stddev_pop(dur) OVER w END, 5) AS z_dur,
  round(CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 5) AS z_score
FROM (SELECT g.*, "end" - "start" AS dur, score FROM ({with_views(' SELECT * FROM seg', 'seg')}) g JOIN ({_TALK}) USING (id)) WINDOW w AS (PARTITION BY video_name)""",
    "robust_logistic": with_views(""", x AS (SELECT id, video_name, "end" - "start" AS v FROM seg), c AS (SELECT video_name, quantile_cont(v, 0.35) AS c, stddev_pop(v) AS sd FROM x GROUP BY 1),
m AS (SELECT video_name, any_value(c) AS c, any_value(sd) AS sd, median(abs(v - c)) AS mad FROM x JOIN c USING (video_name) GROUP BY 1), u AS (SELECT *, CASE WHEN mad > 1e-6 THEN mad ELSE sd END AS u FROM m)
SELECT id, round(CASE WHEN u < 1e-6 THEN 0.5 ELSE 1 / (1 + exp(-greatest(-20, least(20, (v - c) / u + 0.30)))) END, 5) AS prob FROM x JOIN u USING (video_name)""", "seg"),
    "prototypes": """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY 1),
p AS (SELECT label, i, avg(v / n) AS p FROM e JOIN n USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, round(sum(v * p) / sqrt(sum(v * v) * sum(p * p)), 5) AS similarity FROM e JOIN p USING (label, i) GROUP BY vec_id""",
    "title_groups": with_views(f""", k AS (SELECT video_name, id, "start", "end", {_TITLE} AS title FROM kno),
g AS (SELECT video_name, title, arg_min(id, struct_pack(a := "start", b := id)) AS first_id, count(*) AS parts, CAST(sum(ceil("end") - floor("start")) AS BIGINT) AS duration, CAST(floor(min("start")) AS BIGINT) AS a, CAST(ceil(max("end")) AS BIGINT) AS b FROM k GROUP BY 1, 2)
SELECT video_name, title, first_id, parts, duration, {_HMS.format(x='a')} AS "start", {_HMS.format(x='b')} AS "end" FROM g""", "kno"),
    "final_stats": with_views(""" SELECT video_name, count(*) FILTER ("end" - "start" >= 20) AS clips, count(*) FILTER ("end" - "start" < 20) AS removed, CAST(coalesce(sum(ceil("end") - floor("start")) FILTER ("end" - "start" >= 20), 0) AS BIGINT) AS duration FROM kno GROUP BY video_name""", "kno"),
    "class_weights": with_views(", n AS (SELECT CAST(boundary AS INT) AS label, count(*) AS n FROM tl GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) * CASE WHEN label = 1 THEN 3 ELSE 1 END, 6) AS weight FROM n", "tl"),
    "classification_report": with_views(""", l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (slide = (label = 1) AND boundary = (label = 1)) AS hit, count(*) FILTER (slide = (label = 1)) AS g, count(*) FILTER (boundary = (label = 1)) AS t FROM l, tl GROUP BY label)
SELECT label, round(coalesce(hit / nullif(g, 0), 0), 6) AS precision, round(coalesce(hit / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(g + t, 0), 0), 6) AS f1,
  round(sum(coalesce(2 * hit / nullif(g + t, 0), 0) * t) OVER () / sum(t) OVER (), 6) AS weighted_f1, t AS support FROM c WHERE g + t > 0""", "tl"),
    "dynamic_boundary_threshold": with_views(""", r AS (SELECT video_name, avg(CAST(slide AS INT)) AS a, avg(CAST(silent AS INT)) AS b FROM tl GROUP BY 1)
SELECT video_name, CAST(round(least(greatest(0.5 + CASE WHEN a >= 0.04 THEN 0.05 ELSE 0 END + CASE WHEN b >= 0.3 THEN 0.03 ELSE 0 END - CASE WHEN a <= 0.01 AND b <= 0.15 THEN 0.05 ELSE 0 END, 0.35), 0.75), 4) AS DOUBLE) AS threshold FROM r""", "tl"),
    "dynamic_interference_threshold": with_views(f""", r AS (SELECT video_name, round(avg(CAST(present AS INT)), 3) AS p, round(avg(CAST(silent AS INT)), 3) AS q FROM tl GROUP BY 1), n AS (SELECT video_name, count(*) AS n FROM sli GROUP BY 1)
SELECT video_name, CAST(round(least(greatest(0.70 + CASE WHEN p < 0.55 THEN 0.08 WHEN p > 0.9 THEN -0.05 ELSE 0 END + CASE WHEN coalesce(n, 0) / greatest(duration, 1) > 0.02 THEN 0.03 ELSE 0 END, 0.5), 0.9), 4) AS DOUBLE) AS absent,
  CAST(round(least(greatest(0.80 + CASE WHEN q > 0.35 THEN 0.05 WHEN q < 0.12 THEN -0.05 ELSE 0 END, 0.6), 0.95), 4) AS DOUBLE) AS quiet, CAST(15 + CASE WHEN q > 0.35 THEN 3 WHEN q < 0.12 THEN -2 ELSE 0 END AS DOUBLE) AS seconds
FROM r JOIN {_DUR} USING (video_name) LEFT JOIN n USING (video_name)""", "tl", "sli", "seg", "sam"),
    "run_summary": with_views(" SELECT video_name, " + ", ".join(f"CASE WHEN video_name IN (SELECT video_name FROM {t}) THEN 'ok' ELSE 'missing' END AS {n}" for n, t in (("visual", "sam"), ("audio", "seg"), ("text", "kno"), ("align", "tl"))) + " FROM (SELECT DISTINCT video_name FROM multimodal_index)", "sam", "seg", "kno", "tl"),
    "balance": with_views(f""", t AS (SELECT video_name, id, CAST(boundary AS INT) AS label FROM tl), p AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM t)
SELECT video_name, id, label FROM t, p QUALIFY label = 1 OR p = 0 OR n = 0 OR row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, video_name, id) <= 3 * p""", "tl"),
    "split": with_views(f""", t AS (SELECT video_name, id, CAST(boundary AS INT) AS label FROM tl)
SELECT video_name, id, label, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, video_name, id) <= ceil(round(count(*) OVER (PARTITION BY label) * 0.2, 6)) AS held_out FROM t""", "tl"),
}


def queries() -> dict:
    named = {"class_weights": class_weights_query, "split": split_rows}
    return {n: named.get(n) or globals()[n] for n in _SQL}


def oracle_sql() -> dict[str, str]:
    return _SQL
