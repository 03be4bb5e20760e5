"""Predicates and scalar functions on the recording tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import vision
from chalkline.functions.scripts import convert_script, script_table
from chalkline.operators.fuzzy import best_terms, corrected_texts
from chalkline.operators.segment import LONGEST, fixed_words, tokenised
from chalkline.queries._views import KEEP, SILENCE, STRIP, with_views
from chalkline.sources import lecture as L
from chalkline.sources.tables import table


def keep_speech(s, d):
    g = L.segments(s, d)
    return g.select("id", X.silence_probability(F.col("nsp")).alias("nsp"), X.keeps_speech(F.col("nsp"), F.col("text")).alias("keep"),
                    F.coalesce(1 - F.col("nsp") < C.CONFIG.low_confidence, F.lit(False)).alias("low_confidence"))


def semantic_valid(s, d):
    g = L.segments(s, d).withColumn("text", X.normalize_text(F.col("text")))
    return g.select("id", "text", ((F.length("text") >= C.CONFIG.min_text) & X.keeps_speech(F.col("nsp"), F.col("text"))).alias("valid"))


def silence_flag(s, d):
    """Whether each recording begins in silence: its first segment isn't kept, or it has none."""
    first = L.segments(s, d).groupBy("video_name").agg(F.min_by(F.struct("nsp", "text"), F.struct("start", "id")).alias("f"))
    names = table(s, d, "multimodal_index").select("video_name").distinct()
    silent = F.coalesce(~X.keeps_speech(F.col("f.nsp"), F.col("f.text")), F.lit(True))
    return names.join(first, "video_name", "left").select("video_name", F.when(F.col("f").isNull(), True).otherwise(silent).alias("silent"))


def fullscreen_presence(s, d):
    g = L.samples(s, d)
    return g.select("id", vision.is_present(F.col("motion_ratio"), F.col("static_person"), F.col("full_screen")).alias("present"))


def presence_cached(s, d):
    """Samples with the person detector asked at every second one that shows neither motion nor a full screen."""
    need = ~((F.col("motion_ratio") > C.CONFIG.presence_motion) | F.col("full_screen"))
    g = vision.cached_detection(L.samples(s, d), "video_name", ["time", "id"], need, F.col("static_person"))
    return g.select("id", F.col("detected").alias("static_person"), vision.is_present(F.col("motion_ratio"), F.col("detected"), F.col("full_screen")).alias("present"))


def region_crop(s, d):
    """The middle of each vector taken as an image of eight rows."""
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    c = vision.crop(image, 0.2, 0.3, 0.8, 0.9)
    return table(s, d, "embeddings").select("vec_id", F.size(c).alias("height"), F.size(F.get(c, F.lit(0))).alias("width"), F.round(F.get(F.get(c, F.lit(0)), F.lit(0)).cast("double"), 5).alias("first"))


def frame_statistics(s, d):
    """Mean, deviation and their ratio over the frames of each vector, shifted to be positive as loudness is."""
    x = vision.frame_statistics(F.transform("embedding", lambda v: v.cast("double") + 10))
    return table(s, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", *(F.round(f"x.{c}", 6).alias(c) for c in ("mean", "deviation", "variation")))


def fullscreen_ratios(s, d):
    p = table(s, d, "part")
    b, l, e = F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, (F.col("p_partkey") % 200) / 10000.0
    return p.select("p_partkey", vision.is_full_screen(b, l, e).alias("full_screen"))


def person_gate(s, d):
    boxes = F.array(*(F.struct(((F.col("p_partkey") * k) % 50 / 100.0).alias("weight"), ((F.col("p_size") * k) % 40 / 1000.0).alias("area")) for k in (1, 3, 7)))
    return table(s, d, "part").select("p_partkey", vision.has_person(boxes, F.lit(64) + F.col("p_size") % 2 - 1, F.lit(80)).alias("person"))


def frame_ssim(s, d):
    """Similarity of every vector with the next id's, as grey images."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", F.round(vision.ssim(F.col("v"), F.col("w")), 5).alias("ssim"))


def ocr_merge(s, d):
    lines = L.slides(s, d).select("id", F.posexplode(F.split("text", r"\r\n|\n")).alias("line", "t"))
    boxes = lines.withColumn("conf", (F.col("id") * 7 + F.col("line") * 13) % 31 / 100.0)
    return vision.recognised_text(boxes, ["id"], "line", "t", "conf")


def _time_text():
    x = F.col("start").cast("bigint")
    return F.when(F.col("id") % 4 == 0, X.hms(x)).when(F.col("id") % 4 == 1, x.cast("string")).when(F.col("id") % 4 == 2, "1:99:00").otherwise(F.concat(F.lit(" "), x.cast("string"), F.lit(" ")))


def parse_time(s, d):
    return L.knowledge(s, d).withColumn("t", _time_text()).select("id", "t", X.parse_seconds(F.col("t")).alias("seconds"))


def annotations(k):
    """Annotations with bounds that may be missing or reversed: id, video_name, start, end, title, is_interference."""
    text = dict(k.dtypes)
    a, b = (X.parse_seconds(F.col(c)) if text[c] == "string" else F.col(c).cast("double") for c in ("start", "end"))
    lo, hi = F.floor(F.least(a, b)), F.ceil(F.greatest(a, b))
    return (
        k.where(a.isNotNull() & b.isNotNull())
        .select("video_name", "id", lo.alias("start"), hi.alias("end"), X.strip(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("is_interference", F.lit(False)).alias("is_interference"))
        .where("end - start > 1e-6")
    )


def raw_annotations(s, d):
    from chalkline.operators.versions import latest_version

    k = latest_version(table(s, d, "knowledge_segments"), "ks_id", ["video_name", "start", "end", "title"])
    return k.where("video_name is not null").select("video_name", F.col("ks_id").alias("id"), "start", "end", "title", (F.col("ks_id") % 5 == 0).alias("is_interference"))


def normalize_annotations(s, d):
    return annotations(raw_annotations(s, d))


def hms_format(s, d):
    a, b = X.hms_range(F.col("start"), F.col("end"))
    return L.segments(s, d).select("id", a.alias("start_hms"), b.alias("end_hms"), (F.ceil("end") - F.floor("start")).alias("duration"))


def sanitize_title(s, d):
    t = X.clean_title(F.col("title"), F.col("id"))
    return L.knowledge(s, d).select("id", t.alias("title"), X.file_name(t).alias("file_name"))


def normalize_text(s, d):
    return L.segments(s, d).select("id", X.normalize_text(F.col("text")).alias("text"))


def boundary_score(s, d):
    return L.timeline(s, d).select("video_name", "id", F.round(X.boundary_score(F.col("silent"), F.col("slide"), F.col("confidence")), 6).alias("score"))


def levenshtein_fuzzy(s, d):
    """Title words against the keywords of all segments."""
    k = L.knowledge(s, d)
    tokens = k.select(F.explode(F.split(X.clean_title(F.col("title"), F.col("id")), "_")).alias("token"))
    terms = k.select(F.explode("keywords").alias("term")).select(F.regexp_replace("term", " ", "").alias("term")).where("length(term) > 3").union(
        k.sparkSession.createDataFrame([(t,) for t in C.TERMS], "term string")
    )
    noisy = tokens.select(F.explode(F.array("token", F.concat(F.lit("x"), F.substring("token", 2, 100)))).alias("token"))
    return best_terms(noisy, terms, "token", "term").drop("norm")


def transcript_correction(s, d):
    """Segments with misheard domain terms put right by sound: the text, what it was and the replacements, null where nothing changed."""
    return corrected_texts(L.segments(s, d), "id", "text", list(C.TERMS))


def correction_counts(s, d):
    """Counters of the correction and of the script conversion."""
    g = transcript_correction(s, d)
    return g.agg(
        F.lit(True).alias("enabled"), F.count_if(X.strip(F.coalesce("text_raw", "text")) != "").alias("attempted"), F.count("text_raw").alias("changed"),
        F.coalesce(F.sum(F.size("text_correction")), F.lit(0)).alias("replacements"),
    )


def edit_distance(s, d):
    return L.knowledge(s, d).select("id", F.levenshtein("title", F.coalesce(F.get("keywords", F.lit(0)), F.lit(""))).alias("distance"))


def teacher_talk_score(s, d):
    return L.segments(s, d).select("id", F.round(X.teacher_talk_score(F.col("text")), 6).alias("score"))


def token_filter(s, d):
    """Distinct tokens of the transcripts, whether they are valid and whether they are Han."""
    t = tokenised(L.segments(s, d).select("id", X.normalize_text(F.col("text")).alias("text")), ["id"], "text").select("token").distinct()
    return t.select("token", X.is_valid_token(F.col("token")).alias("valid"), X.is_cjk(F.col("token")).alias("cjk"))


def script_t2s(s, d, mode="t2s"):
    """Per recording: the conversion's status, segments that it looked at and changed."""
    table = script_table(s, mode)
    g = L.segments(s, d).withColumn("old", F.translate("text", "这个们", "這個們"))
    new = convert_script(F.col("old"), table)
    looked = F.count_if(F.col("old") != "") if table[0] == "ok" else F.count("*")
    return g.groupBy("video_name").agg(F.lit(table[0]).alias("status"), looked.alias("attempted"), F.count_if(new != F.col("old")).alias("changed"))


def script_round_trip(s, d):
    """Segments whose text is another in traditional characters, that text, and whether converting it back gives the first."""
    there, back = script_table(s, "s2t"), script_table(s, "t2s")
    g = L.segments(s, d).select("id", "text", convert_script(F.col("text"), there).alias("traditional")).where("text <> traditional")
    return g.select("id", "traditional", (convert_script(F.col("traditional"), back) == F.col("text")).alias("same"))


def cue_hit(s, d):
    t = X.strip(F.col("text"))
    long = F.length(t) >= 3
    return L.segments(s, d).select("id", (long & X.any_of(t, C.QUESTION_CUES)).alias("question"), (long & X.any_of(t, C.ANSWER_CUES)).alias("answer"))


def point_text(s, d):
    return L.timeline(s, d).select("video_name", "id", F.substring(X.strip(F.concat_ws(" ", "speech_text", "ppt_text")), 1, 60).alias("text"))


_ANY = lambda cues: "(" + " OR ".join(f"contains(t, '{c}')" for c in cues) + ")"
_HITS = lambda cues: "(" + " + ".join(f"CAST(contains({{c}}, '{c}') AS INT)" for c in cues) + ")"
_OCC = "CAST((length({c}) - length(replace({c}, '{x}', ''))) / {n} AS INT)"
_SQUEEZE = lambda c: STRIP.format(c=f"regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g')")


def _norm(c: str) -> str:
    for a, b in sorted(C.REPLACEMENTS.items(), key=lambda x: (-len(x[0]), x[0])):
        c = f"replace({c}, '{a}', '{b}')"
    return _SQUEEZE(c)


_TITLE = r"""coalesce(nullif(trim(regexp_replace(trim(title), '^\s*知识点\s*[0-9]+\s*[-_—:：]?\s*', '')), ''), nullif(trim(title), ''), '片段' || CAST(id + 1 AS VARCHAR))"""
_STOP = ", ".join(f"'{w}'" for w in (*C.STOP_WORDS, *C.KEYWORD_BLACKLIST))
VALID = f"(length(token) > 1 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({_STOP}) AND regexp_matches(token, '[\\p{{L}}\\p{{N}}]'))"
_EDGES = ", ".join(f"'{w}'" for w in C.STOP_WORDS if len(w) == 1)
_WORDS = ", ".join(f"'{w}'" for w in fixed_words(C.TERMS, C.STOP_WORDS, C.KEYWORD_BLACKLIST))


def SEGMENT(texts: str, keys: str) -> str:
    """Views up to tk0 (keys, token): the tokens of view ``texts`` (keys, text), Han runs by words of the corpus, the longest first."""
    return f"""sg0 AS (SELECT {keys}, unnest(regexp_extract_all(regexp_replace(text, '([\\x{{4e00}}-\\x{{9fff}}]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+')) AS run FROM {texts}),
sg1 AS (SELECT run, count(*) AS n FROM sg0 WHERE regexp_matches(run, '^[\\x{{4e00}}-\\x{{9fff}}]') GROUP BY 1),
sg2 AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS p FROM sg1), sg3 AS (SELECT run, n, p, unnest(range(1, least({LONGEST}, length(run) - p + 1) + 1)) AS k FROM sg2),
sg4 AS MATERIALIZED (SELECT run, n, substring(run, p, k) AS g, CASE WHEN p > 1 THEN substring(run, p - 1, 1) ELSE '' END AS b, substring(run, p + k, 1) AS a FROM sg3),
sg5 AS (SELECT g, sum(n) AS c, count(DISTINCT b) AS l, count(DISTINCT a) AS r FROM sg4 GROUP BY 1),
sg6 AS (SELECT g, c, unnest(range(1, length(g))) AS k FROM sg5 WHERE length(g) > 1 AND c >= 5 AND l >= 3 AND r >= 3 AND left(g, 1) NOT IN ({_EDGES}) AND right(g, 1) NOT IN ({_EDGES})),
sg7 AS (SELECT g AS w FROM (SELECT sg6.g, CAST(sg6.c * (SELECT sum(n * length(run)) FROM sg1) AS DOUBLE) / CAST(x.c * y.c AS DOUBLE) AS tie FROM sg6 JOIN sg5 x ON x.g = left(sg6.g, sg6.k) JOIN sg5 y ON y.g = substring(sg6.g, sg6.k + 1)) GROUP BY g HAVING min(tie) >= 20
  UNION SELECT unnest([{_WORDS}])),
sg8 AS (SELECT run, string_agg(w, '|' ORDER BY length(w) DESC, w) AS pattern FROM (SELECT DISTINCT run, w FROM sg4 JOIN sg7 ON w = g) GROUP BY 1),
sg9 AS (SELECT run, regexp_extract_all(run, pattern) AS tokens FROM sg8),
tk0 AS (SELECT {keys}, unnest(tokens) AS token FROM sg0 JOIN sg9 USING (run) UNION ALL SELECT {keys}, run FROM sg0 WHERE NOT regexp_matches(run, '^[\\x{{4e00}}-\\x{{9fff}}]'))"""


RAW_ANN = """SELECT video_name, ks_id AS id, "start" AS a, "end" AS b, title, ks_id % 5 = 0 AS is_interference FROM (
  SELECT * FROM knowledge_segments QUALIFY row_number() OVER (PARTITION BY ks_id ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE video_name IS NOT NULL"""
ANN = f"""SELECT video_name, id, CAST(floor(least(a, b)) AS BIGINT) AS "start", CAST(ceil(greatest(a, b)) AS BIGINT) AS "end",
  trim(coalesce(title, '')) AS title, is_interference FROM ({RAW_ANN}) WHERE a IS NOT NULL AND b IS NOT NULL AND ceil(greatest(a, b)) - floor(least(a, b)) > 1e-6"""
_HMS = "CAST({x} // 3600 AS VARCHAR) || ':' || lpad(CAST({x} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0')"

_SQL = {
    "keep_speech": with_views(f"SELECT id, {SILENCE} AS nsp, {KEEP} AS keep, coalesce(1 - nsp < 0.60, false) AS low_confidence FROM seg", "seg"),
    "semantic_valid": with_views(f", n AS (SELECT id, nsp, {_norm('text')} AS text FROM seg) SELECT id, text, length(text) >= 5 AND {KEEP} AS valid FROM n", "seg"),
    "silence_flag": with_views(f""", f AS (SELECT video_name, NOT {KEEP} AS silent FROM (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY video_name ORDER BY "start", id) = 1))
SELECT n.video_name, coalesce(silent, true) AS silent FROM (SELECT DISTINCT video_name FROM multimodal_index) n LEFT JOIN f ON f.video_name = n.video_name""", "seg"),
    "fullscreen_presence": with_views("SELECT id, motion_ratio > 0.02 OR static_person OR full_screen AS present FROM sam", "sam"),
    "presence_cached": with_views(""", n AS (SELECT *, row_number() OVER w - 1 AS idx, NOT (motion_ratio > 0.02 OR full_screen) AS need FROM sam WINDOW w AS (PARTITION BY video_name ORDER BY time, id)),
b AS (SELECT *, lag(need) OVER w AS was, sum(CASE WHEN need THEN 0 ELSE 1 END) OVER w AS run FROM n WINDOW w AS (PARTITION BY video_name ORDER BY time, id)),
k AS (SELECT *, CASE WHEN need AND (NOT coalesce(was, false) OR idx % 2 = 0) THEN static_person END AS asked FROM b),
l AS (SELECT *, need AND coalesce(last_value(asked IGNORE NULLS) OVER (PARTITION BY video_name, run ORDER BY time, id), false) AS detected FROM k)
SELECT id, detected AS static_person, motion_ratio > 0.02 OR detected OR full_screen AS present FROM l""", "sam"),
    "region_crop": "SELECT vec_id, 5 AS height, 5 AS width, round(CAST(embedding[2 * 8 + 1 + 1] AS DOUBLE), 5) AS first FROM embeddings",
    "frame_statistics": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE + 10 AS x FROM embeddings) SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(stddev_pop(x) / (avg(x) + 1e-6), 6) AS variation FROM e GROUP BY 1""",
    "fullscreen_ratios": "SELECT p_partkey, p_size / 50.0 > 0.35 AND p_partkey % 100 > 45 AND p_partkey % 200 > 50 AS full_screen FROM part",
    "person_gate": "SELECT p_partkey, p_size % 2 = 1 AND (" + " OR ".join(f"(p_partkey * {k} % 50 >= 20 AND p_size * {k} % 40 >= 15)" for k in (1, 3, 7)) + ") AS person FROM part",
    "frame_ssim": """
WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE * 100 AS x, unnest(b.embedding)::DOUBLE * 100 AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM p GROUP BY vec_id)
SELECT vec_id, round((2 * mx * my + 2.55 ** 2) * (2 * c + 7.65 ** 2) / ((mx * mx + my * my + 2.55 ** 2) * (vx + vy + 7.65 ** 2) + 1e-8), 5) AS ssim FROM m""",
    "ocr_merge": with_views(r"""
, b AS (SELECT id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT id, string_split_regex(text, '\r\n|\n') AS l FROM sli)),
c AS (SELECT *, (id * 7 + line * 13) % 31 / 100.0 AS conf FROM b)
SELECT id, coalesce(string_agg(t, ' ' ORDER BY line) FILTER (conf >= 0.15 AND t <> ''), string_agg(t, ' ' ORDER BY line) FILTER (conf >= 0.08 AND t <> ''), '') AS text FROM c GROUP BY id""", "sli"),
    "parse_time": with_views(f""", t AS (SELECT id, CAST(floor("start") AS BIGINT) AS x FROM kno)
SELECT id, CASE id % 4 WHEN 0 THEN {_HMS.format(x='x')} WHEN 1 THEN CAST(x AS VARCHAR) WHEN 2 THEN '1:99:00' ELSE ' ' || CAST(x AS VARCHAR) || ' ' END AS t,
  CASE WHEN id % 4 <> 2 THEN CAST(x AS DOUBLE) END AS seconds FROM t""", "kno"),
    "normalize_annotations": ANN,
    "hms_format": with_views(f""", t AS (SELECT id, CAST(floor("start") AS BIGINT) AS a, CAST(ceil("end") AS BIGINT) AS b FROM seg)
SELECT id, {_HMS.format(x='a')} AS start_hms, {_HMS.format(x='b')} AS end_hms, b - a AS duration FROM t""", "seg"),
    "sanitize_title": with_views(f""", t AS (SELECT id, {_TITLE} AS title FROM kno)
SELECT id, title, trim(substring(regexp_replace(title, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), 1, 80)) AS file_name FROM t""", "kno"),
    "normalize_text": with_views(f"SELECT id, {_norm('text')} AS text FROM seg", "seg"),
    "boundary_score": with_views("SELECT video_name, id, round(CASE WHEN silent THEN 1.5 ELSE 0 END + CASE WHEN slide THEN 1.0 ELSE 0 END + greatest(0, 1 - confidence) * 0.5, 6) AS score FROM tl", "tl"),
    "teacher_talk_score": with_views(f""", q AS (SELECT id, {STRIP.format(c='text')} AS t, regexp_replace(text, '[\\s\\p{{Z}}]+', '', 'g') AS p FROM seg)
SELECT id, round(CASE WHEN t = '' THEN -0.2 ELSE {_HITS(C.TEACHER_CUES).format(c='t')} - {_HITS(C.STUDENT_CUES).format(c='t')}
  - 0.25 * (length(t) - length(replace(replace(t, '？', ''), '?', ''))) + least(length(p) / 35.0, 1.6)
  + 0.2 * least({' + '.join(_OCC.format(c='p', x=x, n=len(x)) for x in C.FILLER_CUES)}, 5)
  + 0.35 * least({_HITS([x * 2 for x in C.FILLER_CUES]).format(c='p')}, 3) END, 6) AS score FROM q""", "seg"),
    "token_filter": with_views(f""", t0 AS (SELECT id, {_norm('text')} AS text FROM seg), {SEGMENT('t0', 'id')}, t AS (SELECT DISTINCT token FROM tk0)
SELECT token, {VALID} AS valid, regexp_full_match(token, '[\\x{{4e00}}-\\x{{9fff}}]+') AS cjk FROM t""", "seg"),
    "script_t2s": with_views(f""", o AS (SELECT video_name, translate(text, '这个们', '這個們') AS old FROM seg)
SELECT video_name, 'ok' AS status, count(*) FILTER (old <> '') AS attempted, count(*) FILTER (regexp_matches(old, '[這個們]')) AS changed FROM o GROUP BY video_name""", "seg"),
    "cue_hit": with_views(f""", q AS (SELECT id, {STRIP.format(c='text')} AS t FROM seg)
SELECT id, length(t) >= 3 AND {_ANY(C.QUESTION_CUES)} AS question, length(t) >= 3 AND {_ANY(C.ANSWER_CUES)} AS answer FROM q""", "seg"),
    "point_text": with_views(f"""SELECT video_name, id, substring({STRIP.format(c="(speech_text || ' ' || ppt_text)")}, 1, 60) AS text FROM tl""", "tl"),
}


def queries() -> dict:
    # edit distances have no SQL: the SQL engine counts bytes, not characters
    return {n: globals()[n] for n in (*_SQL, "levenshtein_fuzzy", "edit_distance", "transcript_correction", "correction_counts", "script_round_trip")}


def oracle_sql() -> dict[str, str]:
    return _SQL
