"""Interference, edit commands and the final index on the recording tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import islands as I
from chalkline.operators.alignment import SHARD_S
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise
from chalkline.queries import windows as W
from chalkline.queries import models as FM
from chalkline.queries._views import with_views
from chalkline.queries.aggregates import thresholds
from chalkline.queries.joins import _points_in_segment, duration_infer, overlap
from chalkline.queries.scalars import ANN, annotations, raw_annotations
from chalkline.sources import lecture as L

RECODE = " -c:v libx264 -c:a aac"
SOURCES = ("knowledge_segment", "silence_scan", "teacher_non_knowledge_talk", "teacher_student_qa", "model")


def _row(df, rank, reasons, absent=0.0, silent=0.0):
    as_col = lambda x: x if hasattr(x, "alias") else F.lit(x)
    return df.select(
        "video_name", "start", "end", F.lit(rank).alias("rank"), reasons.alias("reasons"), as_col(absent).alias("absent"), as_col(silent).alias("silent"),
    )


def interference_parts(s, d, model=None):
    """The stretches each rule and the model find, not yet merged, with their reasons. ``model``: its stretches, by default those of a rule."""
    # the points each once, which all rules read; each would find them anew
    t = L.points(s, d, "video_name", "id", "time", "present", "silent", "speaker", "speech_text")
    th = thresholds(s, d, t)
    k = L.knowledge(s, d)
    per = _points_in_segment(s, d, t).groupBy("ks_id").agg(F.avg((~F.col("present")).cast("int")).alias("a"), F.avg(F.col("silent").cast("int")).alias("q"))
    hit = per.join(k, per.ks_id == k.id).join(th, "video_name").where((F.round("a", 9) > F.col("absent")) | (F.round("q", 9) > F.col("quiet")))
    why = F.filter(F.array(F.when(F.round("a", 9) > F.col("absent"), F.concat(F.lit("教师缺席 "), percent(F.col("a")))), F.when(F.round("q", 9) > F.col("quiet"), F.concat(F.lit("静默占比 "), percent(F.col("q"))))), lambda x: x.isNotNull())
    know = _row(hit, 0, why, F.round("a", 3), F.round("q", 3))
    still = I.flag_islands(t.select("video_name", "id", "time", "silent", "_shard"), "video_name", F.col("silent")).withColumn("end", F.col("next_time")).join(th, "video_name").where(F.col("end") - F.col("start") >= F.col("seconds"))
    talk = W.rule_a(s, d, timeline=t.select("video_name", "id", "time", "present", "silent", "speaker", "_shard"))
    qa, model = W.qa(s, d, timeline=t), W.model_ranges(s, d) if model is None else model
    why = lambda x: F.array(F.lit(x))
    quiet = F.array(F.concat(F.lit("连续静默 "), seconds(F.col("end") - F.col("start")), F.lit("s")))
    return (
        know.unionByName(_row(still, 1, quiet, 0.0, 1.0)).unionByName(_row(talk, 2, why("教师闲聊/过渡语（非知识点内容）")))
        .unionByName(_row(qa, 3, why("师生问答互动"))).unionByName(_row(model, 4, why("模型预测干扰")))
    )


def percent(ratio):
    """A ratio as whole percent, half up."""
    return F.concat(F.floor(F.round(ratio * 100, 6) + 0.5).cast("bigint").cast("string"), F.lit("%"))


def seconds(x):
    """Seconds with one decimal, half up."""
    tenths = F.floor(F.round(x * 10, 6) + 0.5).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def interference(s, d, model=None):
    """Merged interference: video_name, start, end, reasons in order, sources sorted, largest ratios."""
    parts = materialise(interference_parts(s, d, model))
    order = F.struct("start", "end", "rank", "reasons")
    listed = F.sort_array(F.collect_list(order))
    reasons = F.array_distinct(F.flatten(F.transform(listed, lambda x: x["reasons"])))
    names = F.array(*map(F.lit, SOURCES))
    sources = F.array_sort(F.transform(F.array_distinct(F.transform(listed, lambda x: x["rank"])), lambda r: names[r]))
    return I.union_intervals(
        parts, "video_name", ["start", "end", "rank"],
        (reasons.alias("reasons"), sources.alias("sources"), F.round(F.max("absent"), 3).alias("absent"), F.round(F.max("silent"), 3).alias("silent")),
    )


def detect_interference(s, d, model=None):
    return interference(s, d, model).select("video_name", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.array_join("reasons", "+").alias("reasons"), F.array_join("sources", "+").alias("sources"), "absent", "silent")


def interference_union(s, d):
    """The stretches of all five sources in one list, not yet merged."""
    names = F.array(*map(F.lit, SOURCES))
    p = interference_parts(s, d).withColumn("source", names[F.col("rank")])
    return p.select("video_name", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "source", F.array_join("reasons", "+").alias("reasons"), "absent", "silent")


def edits(s, d, model=None, cfg=C.CONFIG, found=None):
    """Every topic with what becomes of it: kept with padding, or dropped and why. ``found``: the merged interference, if it is there already."""
    k = L.knowledge(s, d)
    bad = (interference(s, d, model) if found is None else found).select("video_name", "start", "end", F.col("end").alias("ord"))
    over = overlap(k, bad, 0.5).select("id", "ratio")
    length = F.col("end") - F.col("start")
    a = k.join(over, "id", "left").join(duration_infer(s, d), "video_name", "left")
    action = F.when(F.col("ratio").isNotNull(), "knowledge_overlap_filter").when(length < cfg.min_segment, "min_duration_filter").otherwise("keep")
    return a.select(
        "video_name", "id", X.clean_title(F.col("title"), F.col("id")).alias("title"), "start", "end", action.alias("action"),
        F.when(F.col("ratio").isNotNull(), F.concat(F.lit("与干扰区间重叠 "), percent(F.col("ratio")))).when(
            length < cfg.min_segment, F.concat(F.lit("片段过短 "), seconds(length), F.lit("s < "), seconds(F.lit(cfg.min_segment)), F.lit("s"))
        ).alias("reason"),
        F.round(F.greatest(F.lit(0.0), F.col("start") - cfg.padding), 2).alias("cut_from"),
        F.round(F.least(F.coalesce("duration", "end"), F.col("end") + cfg.padding), 2).alias("cut_to"),
    )


def overlap_first(s, d):
    """Topics with the first stretch of interference that covers more than half of them."""
    bad = interference(s, d).select("video_name", "start", "end", F.col("end").alias("ord"))
    return overlap(L.knowledge(s, d), bad, 0.5).select("id", F.round("ord", 2).alias("until"), F.round("ratio", 6).alias("ratio"))


def edit_commands(s, d, model=None):
    """Clips to cut, numbered from 0 in each recording by start."""
    kept = edits(s, d, model).where("action = 'keep'").withColumn("_shard", F.floor(F.col("start") / SHARD_S))
    n = sharded_scan(materialise(kept), ["video_name"], "_shard", ["start", "id"], {"n": ("sum", F.lit(1))})
    return n.select("video_name", (F.col("n") - 1).cast("bigint").alias("clip"), "title", "cut_from", "cut_to", F.round(F.col("cut_to") - F.col("cut_from"), 2).alias("duration"))


def removed_segments(s, d, model=None):
    """Merged interference and dropped topics in one list."""
    found = materialise(interference(s, d, model))
    a = found.select("video_name", "start", "end", F.array_join("sources", "+").alias("source"), F.array_join("reasons", "|").alias("reasons"))
    b = edits(s, d, model, found=found).where("action <> 'keep'").select("video_name", "start", "end", F.col("action").alias("source"), F.col("reason").alias("reasons"))
    return a.unionByName(b).select(
        "video_name", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round(F.col("end") - F.col("start"), 2).alias("duration"), "source", "reasons",
        F.lit("not_exported").alias("output_policy"),
    )


def final_index(s, d, model=None):
    """Clips by title: first clip, parts, duration and file name; and how each is made."""
    e = edit_commands(s, d, model)
    g = e.groupBy("video_name", "title").agg(F.min("clip").alias("first_clip"), F.count("*").alias("parts"), F.min("cut_from").alias("a"), F.max("cut_to").alias("b"), F.sum("duration").alias("sum"))
    a, b = X.hms_range(F.col("a"), F.col("b"))
    length = F.when(F.col("parts") == 1, F.ceil("b") - F.floor("a")).otherwise(F.floor(F.round("sum", 2)))
    return g.select("video_name", "title", "first_clip", "parts", a.alias("start"), b.alias("end"), length.cast("bigint").alias("duration"), F.concat(X.file_name(F.col("title")), F.lit(".mp4")).alias("output_file"))


def media_commands(s, d, model=None):
    """The cut of each clip and, for titles of several, the joining of its parts, as arguments for a media tool.

    ``fallback`` encodes anew; it is for a first attempt that fails or leaves a file of 1,024 bytes or less.
    """
    e = edit_commands(s, d, model)
    out = F.concat("video_name", F.lit("_"), F.col("clip").cast("string"), F.lit(".mp4"))
    part = F.concat_ws(" ", F.lit("-ss"), F.format_string("%.2f", "cut_from"), F.lit("-to"), F.format_string("%.2f", "cut_to"))
    cut = e.select("video_name", out.alias("output"), F.lit("cut").alias("kind"), F.concat(part, F.lit(" -c copy")).alias("arguments"), F.concat(part, F.lit(RECODE)).alias("fallback"))
    j = e.withColumn("out", out).groupBy("video_name", "title").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("clip", "out"))).alias("p")).where("n > 1")
    parts = F.array_join(F.transform("p", lambda x: x["out"]), "|")
    join = j.select("video_name", F.concat(X.file_name(F.col("title")), F.lit(".mp4")).alias("output"), F.lit("concat").alias("kind"), F.concat(parts, F.lit(" -c copy")).alias("arguments"), F.concat(parts, F.lit(RECODE)).alias("fallback"))
    return cut.unionByName(join)


def _by_forests(query):
    """The query with the stretches of the forests as its model source; they are trained once, and all points are found once."""

    def run(s, d):
        with L.points_kept():
            return query(s, d, materialise(FM.forest_ranges(s, d)))

    return run


FOREST = {"forest_" + f.__name__: _by_forests(f) for f in (detect_interference, edit_commands, removed_segments, final_index, media_commands)}


def annotated_clips(s, d):
    """The annotated topics as clips without any model: those of one title are the parts of one clip, in order of start."""
    a = annotations(raw_annotations(s, d)).where("not is_interference").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("未命名")))
    g = a.groupBy("video_name", "title").agg(F.count("*").alias("parts"), F.min("start").alias("first"), F.sum(F.col("end") - F.col("start")).alias("duration"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("p"))
    cut = F.array_join(F.transform("p", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), "|")
    return g.select("video_name", "title", "parts", "first", "duration", cut.alias("cuts"), F.concat(X.file_name(F.col("title")), F.lit(".mp4")).alias("output_file"))


_TH = """th AS (SELECT video_name, least(greatest(0.70 + CASE WHEN p < 0.55 THEN 0.08 WHEN p > 0.9 THEN -0.05 ELSE 0 END + CASE WHEN coalesce(n, 0) / greatest(duration, 1) > 0.02 THEN 0.03 ELSE 0 END, 0.5), 0.9) AS absent,
  least(greatest(0.80 + CASE WHEN q > 0.35 THEN 0.05 WHEN q < 0.12 THEN -0.05 ELSE 0 END, 0.6), 0.95) AS quiet, 15 + CASE WHEN q > 0.35 THEN 3 WHEN q < 0.12 THEN -2 ELSE 0 END AS seconds
FROM (SELECT video_name, round(avg(CAST(present AS INT)), 3) AS p, round(avg(CAST(silent AS INT)), 3) AS q FROM tl GROUP BY 1) JOIN dur USING (video_name) LEFT JOIN (SELECT video_name, count(*) AS n FROM sli GROUP BY 1) USING (video_name))"""
_DUR = """dur AS (SELECT video_name, max(x) AS duration FROM (SELECT video_name, "end" AS x FROM seg UNION ALL SELECT video_name, time FROM sam) GROUP BY video_name)"""
_two = W.RULE_A.replace("i0", "j0").replace("i1", "j1").replace("isl", "jsl")
_MODEL = """mp AS (SELECT DISTINCT video_name, round(time, 2) AS time FROM tl WHERE CASE WHEN silent THEN 1.5 ELSE 0 END + CASE WHEN slide THEN 1.0 ELSE 0 END + greatest(0, 1 - confidence) * 0.5 >= 0.1),
mr AS (SELECT *, sum(CASE WHEN time - b <= 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY video_name ORDER BY time) AS k FROM (SELECT *, lag(time) OVER (PARTITION BY video_name ORDER BY time) AS b FROM mp)),
mo AS (SELECT * FROM (SELECT video_name, min(time) AS "start", max(time) AS "end" FROM mr GROUP BY video_name, k) WHERE "end" - "start" >= 5)"""
_PERCENT = "CAST(CAST(floor(round({x} * 100, 6) + 0.5) AS BIGINT) AS VARCHAR) || '%'"
_TENTHS = "CAST(floor(round(({x}) * 10, 6) + 0.5) AS BIGINT)"
_SECONDS = f"CAST({_TENTHS} // 10 AS VARCHAR) || '.' || CAST({_TENTHS} % 10 AS VARCHAR)"
_PARTS = f"""{_DUR}, {_TH}, {W._ISL('tl', 'silent')}, {_two}, {W.QA}, {_MODEL},
ka AS (SELECT kno.video_name, kno.id, any_value("start") AS "start", any_value("end") AS "end", avg(CAST(NOT present AS INT)) AS a, avg(CAST(silent AS INT)) AS q FROM kno JOIN tl ON tl.video_name = kno.video_name AND tl.time BETWEEN "start" AND "end" GROUP BY 1, 2),
pa AS (SELECT video_name, "start", "end", 0 AS rank, list_filter([CASE WHEN round(a, 9) > absent THEN '教师缺席 ' || {_PERCENT.format(x='a')} END, CASE WHEN round(q, 9) > quiet THEN '静默占比 ' || {_PERCENT.format(x='q')} END], lambda x: x IS NOT NULL) AS reasons, round(a, 3) AS absent, round(q, 3) AS silent
    FROM ka JOIN th USING (video_name) WHERE round(a, 9) > absent OR round(q, 9) > quiet
  UNION ALL SELECT video_name, "start", nx, 1, ['连续静默 ' || {_SECONDS.format(x='nx - "start"')} || 's'], 0, 1 FROM isl JOIN th USING (video_name) WHERE nx - "start" >= seconds
  UNION ALL SELECT video_name, "start", "end", 2, ['教师闲聊/过渡语（非知识点内容）'], 0, 0 FROM ra UNION ALL SELECT video_name, "start", "end", 3, ['师生问答互动'], 0, 0 FROM qa UNION ALL SELECT video_name, "start", "end", 4, ['模型预测干扰'], 0, 0 FROM mo),
pm AS (SELECT *, max("end") OVER (PARTITION BY video_name ORDER BY "start", "end", rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pa),
pg AS (SELECT *, sum(CASE WHEN "start" <= reach + 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY video_name ORDER BY "start", "end", rank ROWS UNBOUNDED PRECEDING) AS g FROM pm),
ri AS (SELECT video_name, g, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS i, "start", "end", rank FROM pg),
rf AS (SELECT video_name, g, reason, min(struct_pack(a := "start", b := "end", c := rank, d := i)) AS o FROM ri GROUP BY 1, 2, 3),
rs AS (SELECT video_name, g, string_agg(reason, '+' ORDER BY o) AS reasons FROM rf GROUP BY 1, 2),
pi AS (SELECT video_name, g, min("start") AS "start", max("end") AS "end", round(max(absent), 3) AS absent, round(max(silent), 3) AS silent,
  array_to_string(list_sort(list_distinct(list(CASE rank WHEN 0 THEN 'knowledge_segment' WHEN 1 THEN 'silence_scan' WHEN 2 THEN 'teacher_non_knowledge_talk' WHEN 3 THEN 'teacher_student_qa' ELSE 'model' END))), '+') AS sources FROM pg GROUP BY 1, 2),
it AS (SELECT pi.*, reasons FROM pi JOIN rs USING (video_name, g))"""
_TITLE = r"coalesce(nullif(trim(regexp_replace(trim(title), '^\s*知识点\s*[0-9]+\s*[-_—:：]?\s*', '')), ''), nullif(trim(title), ''), '片段' || CAST(id + 1 AS VARCHAR))"
_EDIT = f"""{_PARTS}, ov AS (SELECT id, ratio FROM (SELECT k.id, it."start" AS s, it."end" AS e, (least(k."end", it."end") - greatest(k."start", it."start")) / greatest(k."end" - k."start", 0.001) AS ratio FROM kno k JOIN it ON it.video_name = k.video_name)
  WHERE ratio > 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, e) = 1),
ed AS (SELECT kno.video_name, kno.id, {_TITLE.replace('id +', 'kno.id +')} AS title, "start", "end", CASE WHEN ov.id IS NOT NULL THEN 'knowledge_overlap_filter' WHEN "end" - "start" < 20 THEN 'min_duration_filter' ELSE 'keep' END AS action,
  CASE WHEN ov.id IS NOT NULL THEN '与干扰区间重叠 ' || {_PERCENT.format(x='ratio')} WHEN "end" - "start" < 20 THEN '片段过短 ' || {_SECONDS.format(x='"end" - "start"')} || 's < 20.0s' END AS reason,
  round(greatest(0, "start" - 5), 2) AS cut_from, round(least(coalesce(duration, "end"), "end" + 5), 2) AS cut_to FROM kno LEFT JOIN ov ON ov.id = kno.id LEFT JOIN dur ON dur.video_name = kno.video_name),
ec AS (SELECT video_name, row_number() OVER (PARTITION BY video_name ORDER BY "start", id) - 1 AS clip, title, cut_from, cut_to, round(cut_to - cut_from, 2) AS duration FROM ed WHERE action = 'keep')"""
_HMS = "CAST({x} // 3600 AS VARCHAR) || ':' || lpad(CAST({x} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0')"
_FILE = """trim(substring(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), 1, 80)) || '.mp4'"""
_ALL = ("tl", "kno", "sli", "seg", "sam")
_DET = f""", {_PARTS} SELECT video_name, round("start", 2) AS "start", round("end", 2) AS "end", reasons, sources, absent, silent FROM it"""

_SQL = {
    "detect_interference": with_views(_DET, *_ALL),
    "interference_union": with_views(f""", {_PARTS} SELECT video_name, round("start", 2) AS "start", round("end", 2) AS "end",
  CASE rank WHEN 0 THEN 'knowledge_segment' WHEN 1 THEN 'silence_scan' WHEN 2 THEN 'teacher_non_knowledge_talk' WHEN 3 THEN 'teacher_student_qa' ELSE 'model' END AS source,
  array_to_string(reasons, '+') AS reasons, absent, silent FROM pa""", *_ALL),
    "overlap_first": with_views(f""", {_PARTS}, p AS (SELECT k.id, it."start" AS s, it."end" AS e, (least(k."end", it."end") - greatest(k."start", it."start")) / greatest(k."end" - k."start", 0.001) AS ratio
  FROM kno k JOIN it ON it.video_name = k.video_name AND it."start" < k."end" AND k."start" < it."end")
SELECT id, round(e, 2) AS until, round(ratio, 6) AS ratio FROM p WHERE ratio > 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, e) = 1""", *_ALL),
    "edit_commands": with_views(f", {_EDIT} SELECT * FROM ec", *_ALL),
    "annotated_clips": f"""WITH a AS (SELECT * REPLACE (coalesce(nullif(title, ''), '未命名') AS title) FROM ({ANN}) WHERE NOT is_interference)
SELECT video_name, title, count(*) AS parts, min("start") AS first, CAST(sum("end" - "start") AS BIGINT) AS duration, string_agg(CAST("start" AS VARCHAR) || '-' || CAST("end" AS VARCHAR), '|' ORDER BY "start", "end") AS cuts, {_FILE} AS output_file FROM a GROUP BY video_name, title""",
    "removed_segments": with_views(f""", {_EDIT} SELECT video_name, round("start", 2) AS "start", round("end", 2) AS "end", round("end" - "start", 2) AS duration, source, reasons, 'not_exported' AS output_policy FROM (
  SELECT video_name, "start", "end", sources AS source, replace(reasons, '+', '|') AS reasons FROM it UNION ALL SELECT video_name, "start", "end", action, reason FROM ed WHERE action <> 'keep')""", *_ALL),
    "final_index": with_views(f""", {_EDIT}, g AS (SELECT video_name, title, min(clip) AS first_clip, count(*) AS parts, CAST(floor(min(cut_from)) AS BIGINT) AS a, CAST(ceil(max(cut_to)) AS BIGINT) AS b, sum(duration) AS s FROM ec GROUP BY 1, 2)
SELECT video_name, title, first_clip, parts, {_HMS.format(x='a')} AS "start", {_HMS.format(x='b')} AS "end", CAST(CASE WHEN parts = 1 THEN b - a ELSE floor(round(s, 2)) END AS BIGINT) AS duration, {_FILE} AS output_file FROM g""", *_ALL),
    "media_commands": with_views(f""", {_EDIT}, c AS (SELECT *, video_name || '_' || CAST(clip AS VARCHAR) || '.mp4' AS out FROM ec)
SELECT video_name, out AS output, 'cut' AS kind, printf('-ss %.2f -to %.2f -c copy', cut_from, cut_to) AS arguments, printf('-ss %.2f -to %.2f -c:v libx264 -c:a aac', cut_from, cut_to) AS fallback FROM c
UNION ALL SELECT video_name, {_FILE}, 'concat', string_agg(out, '|' ORDER BY clip) || ' -c copy', string_agg(out, '|' ORDER BY clip) || ' -c:v libx264 -c:a aac' FROM c GROUP BY video_name, title HAVING count(*) > 1""", *_ALL),
}


def queries() -> dict:
    return {n: globals()[n] for n in _SQL} | FOREST


def oracle_sql() -> dict[str, str]:
    return _SQL
