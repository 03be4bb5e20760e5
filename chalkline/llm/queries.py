"""Queries of the text problems on the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.containers import fill_containers
from chalkline.llm.labels import label_roles
from chalkline.llm.leaks import find_leaks
from chalkline.llm.nearest import nearest_in_time
from chalkline.llm.pieces import cut_pieces
from chalkline.llm.runs import collapse_runs
from chalkline.llm.scans import repair
from chalkline.llm.splits import assign_groups, components, recording_key_col
from chalkline.llm.turns import speaker_turns
from chalkline.operators.versions import latest_version
from chalkline.sources.tables import table


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every slide page and speech segment with its nearest reading, or none."""
    slides = latest_version(table(spark, folder, "ppt_content"), "content_id", ["video_name", "time"])
    speech = latest_version(table(spark, folder, "speech_segments"), "seg_id", ["video_name", "start"])
    readings = latest_version(table(spark, folder, "teacher_timeline"), "sample_id", ["video_name", "time"])
    records = slides.select(
        "video_name", "time", F.lit("slide").alias("rec_kind"), F.col("content_id").alias("rec_id")
    ).unionByName(
        speech.select("video_name", F.col("start").alias("time"), F.lit("speech").alias("rec_kind"), F.col("seg_id").alias("rec_id"))
    )
    return nearest_in_time(
        records, readings, "video_name", "time", "time", ["rec_kind", "rec_id"], ["sample_id"], 2.0
    ).select("l.rec_kind", "l.rec_id", "r.sample_id", "distance_ms")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pairs(spark, folder).where("sample_id is not null").select("rec_kind", "rec_id", "sample_id")


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of time_series: code 0 silent, 1 teacher, 2 student, null no known speaker."""
    points = (
        table(spark, folder, "time_series")
        .select("video_name", "point_id", "time", "is_silence", "speaker")
        .dropDuplicates(["video_name", "point_id"])
    )
    spoken = (~F.col("is_silence")) & F.col("speaker").isNotNull()
    # repeated points have the same label, so labels are taken from the table as it is
    roles = label_roles(table(spark, folder, "time_series").where(spoken).select("video_name", "speaker"), "video_name", "speaker")
    code = F.when(F.col("role") == "teacher", 1).when(F.col("role") == "student", 2)
    # only speaking points with a label are joined; the others know their code
    silent = F.when(F.col("is_silence"), 0)
    coded = points.where(spoken).join(roles, ["video_name", "speaker"], "left").select("video_name", "time", code.alias("code")).unionByName(
        points.where(F.coalesce(~spoken, F.lit(True))).select("video_name", "time", silent.alias("code"))
    )
    return collapse_runs(coded, "video_name", "time", "code")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return (
        p3_runs(spark, folder)
        .where("n_points >= 2")
        .select("video_name", F.col("first_s").cast("bigint").alias("first_s"), F.col("last_s").cast("bigint").alias("last_s"))
    )


def _recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Names of multimodal_index with the recording (component) that each belongs to."""
    names = table(spark, folder, "multimodal_index").select("video_name", "video_path")
    stem = F.regexp_extract("video_path", r"([^/\\]+)$", 1)
    keys = F.explode(F.array(recording_key_col("video_name"), recording_key_col(F.nullif(stem, F.lit("")))))
    return components(names.select("video_name", keys.alias("key")), "video_name", "key")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _recordings(spark, folder)
    long = table(spark, folder, "multimodal_index").groupBy("video_name").agg(F.max("duration").alias("d"))
    one = found.join(long, "video_name")
    a = one.select("component", F.col("video_name").alias("video_a"), F.col("d").alias("d_a"))
    b = one.select("component", F.col("video_name").alias("video_b"), F.col("d").alias("d_b"))
    agree = F.coalesce(F.round(F.abs(F.col("d_a") - F.col("d_b")), 2) <= 1.0, F.lit(True))
    return a.join(b, "component").where((F.col("video_a") < F.col("video_b")) & agree).select("video_a", "video_b")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of multimodal_index with its recording, its number of points and its split."""
    found = _recordings(spark, folder)
    points = (
        table(spark, folder, "time_series").select("video_name", "point_id").distinct().groupBy("video_name").agg(F.count("*").alias("n_points"))
    )
    sized = found.join(points, "video_name", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    # strata: the course, the leading letters and number of the recording's name
    course = F.regexp_extract(recording_key_col("component"), r"^([^_]+_[^_]+)", 1)
    groups = sized.groupBy("component").agg(F.sum("n_points").alias("size")).withColumn("course", course)
    split = assign_groups(groups, table(spark, folder, "split_plan"), "component", "size", "course")
    return sized.join(split, "component").select("video_name", F.col("component").alias("recording"), "n_points", "split_name")


def _repaired(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = latest_version(table(spark, folder, "ppt_content"), "content_id", ["video_name", "text"])
    return repair(pages, "content_id", "video_name", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder)[0]


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as readable paragraphs."""
    return _repaired(spark, folder)[1]


def p6_turns(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["video_name", "start", "end", "text", "speaker"]
    segments = latest_version(table(spark, folder, "speech_segments"), "seg_id", columns)
    return speaker_turns(segments, "video_name", "seg_id", "start", "end", "text", "speaker")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_turns(spark, folder).select(
        "video_name", F.col("first_seg").alias("first_seg_id"), F.col("last_seg").alias("last_seg_id"), "role"
    )


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one over 2,048 tokens, with its container."""
    documents = table(spark, folder, "documents")
    pieces = cut_pieces(documents, "doc_id", "text", 2048, whole=True)
    return fill_containers(pieces, ["doc_id", "piece_no", "start_char", "end_char"], "n_tokens", 2048)


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items they leak, with the number of leaked windows."""
    items = table(spark, folder, "eval_items").withColumn("by_words", F.lower(F.substring("lang", 1, 2)) == "en")
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "text", "by_words")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return cut_pieces(table(spark, folder, "documents"), "doc_id", "text", 1500, overlap=100, with_text=True)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_pieces(table(spark, folder, "documents"), "doc_id", "text", 1500, overlap=100).select("doc_id").distinct()


_LATEST = "(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY ingested_at DESC NULLS LAST) = 1)"
_SLIDES, _SPEECH, _READINGS = (
    _LATEST.format(t=t, k=k)
    for t, k in (("ppt_content", "content_id"), ("speech_segments", "seg_id"), ("teacher_timeline", "sample_id"))
)

_P1 = f"""
WITH l AS (
  SELECT 'slide' AS rec_kind, content_id AS rec_id, video_name, CAST(round(time * 1000) AS BIGINT) AS ms FROM {_SLIDES}
  UNION ALL SELECT 'speech', seg_id, video_name, CAST(round("start" * 1000) AS BIGINT) FROM {_SPEECH}),
r AS (SELECT sample_id, video_name, CAST(round(time * 1000) AS BIGINT) AS ms FROM {_READINGS} WHERE time IS NOT NULL),
b AS (SELECT rec_kind, rec_id, r.sample_id AS s, l.ms - r.ms AS d FROM l ASOF LEFT JOIN r ON l.video_name = r.video_name AND l.ms >= r.ms),
a AS (SELECT rec_kind, rec_id, r.sample_id AS s, r.ms - l.ms AS d FROM l ASOF LEFT JOIN r ON l.video_name = r.video_name AND l.ms <= r.ms),
m AS (
  SELECT b.rec_kind, b.rec_id, CASE WHEN a.d IS NULL OR b.d <= a.d THEN b.s ELSE a.s END AS s, least(a.d, b.d) AS d
  FROM b JOIN a ON b.rec_kind = a.rec_kind AND b.rec_id = a.rec_id)
SELECT rec_kind, rec_id, CASE WHEN d <= 2000 THEN s END AS sample_id, CASE WHEN d <= 2000 THEN d END AS distance_ms FROM m
"""

# The spellings of the two roles in lower case, without space and punctuation.
_ROLE = """CASE WHEN n IN ('teacher', 'lecturer', 't', '教师', '老师', '讲师') THEN 1
  WHEN n IN ('student', 's', 'ｓｔｕｄｅｎｔ', '学生', '学员', '同学') THEN 2 END"""
_P3 = f"""
WITH d AS (SELECT DISTINCT video_name, point_id, time, is_silence, speaker FROM time_series),
n AS (SELECT *, lower(regexp_replace(speaker, '[\\s:：]+', '', 'g')) AS n FROM d),
c AS (SELECT video_name, time, CASE WHEN is_silence THEN 0 ELSE {_ROLE} END AS c FROM n),
k AS (
  SELECT *, sum(CASE WHEN before IS NULL OR time - before > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_name ORDER BY time) AS chain
  FROM (SELECT *, lag(time) OVER (PARTITION BY video_name ORDER BY time) AS before FROM c)),
f AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY video_name, chain ORDER BY time) AS code FROM k),
r AS (
  SELECT *, sum(new) OVER (PARTITION BY video_name, chain ORDER BY time) AS run FROM (
    SELECT *, CASE WHEN code IS NOT DISTINCT FROM lag(code) OVER (PARTITION BY video_name, chain ORDER BY time)
      AND row_number() OVER (PARTITION BY video_name, chain ORDER BY time) > 1 THEN 0 ELSE 1 END AS new FROM f))
SELECT video_name, min(time) AS first_s, max(time) AS last_s, count(*) AS n_points, max(time) - min(time) AS duration_s, any_value(code) AS code
FROM r GROUP BY video_name, chain, run
"""

_FULL, _HALF = "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + " "
_MARK = r"""([\s._-]*(\(\s*(\d+|copy|副本)\s*\)|\[\s*(\d+|copy|副本)\s*\]|副本|\.(mp4|avi|mov|mkv|flv|wmv|webm|m4v))|[\s._-]+(copy|final|export|edit|v\d+|\d{3,4}p))+$"""
_KEY = lambda c: (
    f"""array_to_string(list_transform(regexp_extract_all(regexp_replace(trim(lower(translate({c}, '{_FULL}', '{_HALF}'))), '{_MARK}', ''), '\\d+|\\p{{L}}+'),
  lambda t: CASE WHEN regexp_full_match(t, '\\d+') THEN coalesce(nullif(ltrim(t, '0'), ''), '0') ELSE t END), '_')"""
)
_P2 = f"""
WITH RECURSIVE m AS (SELECT video_name, video_path, duration FROM multimodal_index WHERE video_name IS NOT NULL),
k AS (SELECT DISTINCT video_name AS n, unnest([{_KEY('video_name')}, {_KEY("nullif(regexp_extract(video_path, '([^/' || chr(92) || chr(92) || ']+)$', 1), '')")}]) AS x FROM m),
e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b ON a.x = b.x),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
d AS (SELECT video_name AS n, max(duration) AS d FROM m GROUP BY 1)
SELECT a AS video_a, b AS video_b FROM r JOIN d x ON x.n = a JOIN d y ON y.n = b WHERE a < b AND coalesce(round(abs(x.d - y.d), 2) <= 1.0, true)
"""

# The turns without their texts: SQL has no look-behind, so a part counts by whether a word is left that is no filler.
_SP, _IN, _OUT, _END = r"[\s\p{Z}]", "chr(1)", "chr(3)", "chr(2)"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}"
_TIME_MARK = rf"[\[【（(<]{_SP}*\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d{{1,3}})?{_SP}*[\]】）)>]{_SP}*|{_CLOCK}{_SP}*-->{_SP}*(?:{_CLOCK}{_SP}*)?"
_AFTER = rf"(?:{_SP}*[:：]{_SP}*|>{_SP}+|{_SP}+-{_SP}+)"
_MARKS = (
    r"\[([^\[\]]{1,40})\]|【([^【】]{1,40})】|（([^（）]{1,40})）|\(([^()]{1,40})\)|〔([^〔〕]{1,40})〕|<([^<>]{1,40})>|\*([^*]{1,40})\*"
    rf"|♪+[^♪]{{0,80}}♪+|♪|(^|{_SP})(\p{{L}}+){_AFTER}"
)
_NAME = lambda c: f"""lower(regexp_replace(translate({c}, '{_FULL}', '{_HALF}'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"""
_AS_ROLE = lambda c: f"""CASE WHEN {_NAME(c)} IN ('teacher', 'lecturer', 't', '教师', '老师', '讲师') THEN 'teacher' WHEN {_NAME(c)} IN ('student', 's', '学生', '学员', '同学') THEN 'student' END"""
_P6 = f"""
WITH g AS (SELECT video_name AS k, seg_id AS id, "start" AS a, greatest("start", coalesce(CASE WHEN NOT isnan("end") THEN "end" END, "start")) AS b, {_AS_ROLE('speaker')} AS col_role,
  regexp_replace(regexp_replace(coalesce(text, ''), '{_TIME_MARK}', ' ', 'g'), '{_MARKS}', '\\8' || {_IN} || '\\1\\2\\3\\4\\5\\6\\7' || {_OUT} || '\\9' || {_END}, 'g') AS t
  FROM {_SPEECH} WHERE "start" IS NOT NULL AND NOT isnan("start") AND video_name IS NOT NULL AND seg_id IS NOT NULL),
m AS (SELECT * REPLACE (regexp_replace(t, '(' || {_END} || ')(\\p{{L}}+){_AFTER}', '\\1' || {_IN} || {_OUT} || '\\2' || {_END}, 'g') AS t) FROM g),
p AS (SELECT k, id, a, b, col_role, unnest(string_split(t, {_IN})) AS x, generate_subscripts(string_split(t, {_IN}), 1) AS i FROM m),
q AS (SELECT *, CASE WHEN i > 1 THEN split_part(x, {_OUT}, 1) END AS bracket, CASE WHEN i > 1 THEN split_part(split_part(x, {_OUT}, 2), {_END}, 1) END AS label, CASE WHEN i > 1 THEN split_part(x, {_END}, 2) ELSE x END AS said FROM p),
r AS (SELECT *, coalesce({_AS_ROLE('label')}, {_AS_ROLE('bracket')}) AS role FROM q),
u AS (SELECT k, id, a, b, col_role, i, role, CASE WHEN role IS NULL AND coalesce(label, '') <> '' THEN ' ' || label || ': ' || said ELSE ' ' || said END AS said, sum(CASE WHEN role IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY k, id ORDER BY i) AS part FROM r),
v AS (SELECT k, id, any_value(a) AS a, any_value(b) AS b, any_value(col_role) AS col_role, part, max(role) AS role, string_agg(said, '' ORDER BY i) AS said FROM u GROUP BY k, id, part),
w AS (SELECT * FROM v WHERE len(list_filter(regexp_extract_all(said, '[\\p{{L}}\\p{{N}}_''-]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')
  AND NOT regexp_full_match(x, '(?i:u+h+m*|u+m+|e+r+m?|h+m+|m+h+m+|a+h+|o+h+)') AND NOT regexp_full_match(x, '[嗯呃啊额唔哦]+'))) > 0),
c AS (SELECT k, id, a, b, part, coalesce(role, CASE WHEN row_number() OVER (PARTITION BY k, id ORDER BY part) = 1 THEN col_role END) AS role FROM w),
h AS (SELECT *, last_value(role IGNORE NULLS) OVER (PARTITION BY k ORDER BY a, id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
  max(b) OVER (PARTITION BY k ORDER BY a, id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
n AS (SELECT *, coalesce(role, was) AS now FROM h WHERE coalesce(role, was) IS NOT NULL),
o AS (SELECT *, sum(CASE WHEN was IS NULL OR now <> was OR round((a - reach) * 1000) > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, id, part) AS turn FROM n)
SELECT k AS video_name, arg_min(id, struct_pack(a := a, i := id)) AS first_seg_id, arg_max(id, struct_pack(a := a, i := id)) AS last_seg_id, any_value(now) AS role FROM o GROUP BY k, turn
"""

_FLAT = lambda c: f"lower(nfc_normalize(regexp_replace(translate({c}, '{_FULL}', '{_HALF}'), '\\\\p{{Cf}}+', '', 'g')))"
_P9 = f"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, true AS en, {_FLAT('text')} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'd', doc_id, false, {_FLAT('text')} FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'i', item_id, coalesce(lower(substring(lang, 1, 2)) = 'en', false), {_FLAT('text')} FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT side, id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS u FROM t WHERE en),
c AS (SELECT side, id, regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS u FROM t WHERE NOT en),
x AS (SELECT side, id, 'w' || array_to_string(u[p : p + 11], ' ') AS g FROM (SELECT side, id, u, unnest(range(1, len(u) - 10)) AS p FROM w WHERE len(u) >= 12)
  UNION ALL SELECT side, id, 'c' || substring(u, p, 24) FROM (SELECT side, id, u, unnest(range(1, length(u) - 22)) AS p FROM c WHERE length(u) >= 24))
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM x a JOIN x b ON a.g = b.g WHERE a.side = 'd' AND b.side = 'i'
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_splits": p2_splits, "p3_found": p3_found, "p3_runs": p3_runs, "p5_found": p5_found, "p5_pages": p5_pages, "p6_found": p6_found, "p6_turns": p6_turns,
        "p8_containers": p8_containers, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_pieces": p10_pieces}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT rec_kind, rec_id, sample_id FROM ({_P1}) WHERE sample_id IS NOT NULL",
        "p1_pairs": _P1,
        "p2_found": _P2,
        "p3_found": f"SELECT video_name, CAST(first_s AS BIGINT) AS first_s, CAST(last_s AS BIGINT) AS last_s FROM ({_P3}) WHERE n_points >= 2",
        "p3_runs": _P3,
        "p6_found": _P6,
        "p9_found": _P9,
    }
