"""Term weights, keywords, topic boundaries and speaker folds on the recording tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions import text as X
from chalkline.operators import boundaries as B
from chalkline.operators import keywords as K
from chalkline.operators import speakers as P
from chalkline.operators import stats as S
from chalkline.operators.alignment import as_of, contained, numbered
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise, shuffled
from chalkline.queries._views import KEEP, with_views
from chalkline.queries.scalars import SEGMENT, VALID, _norm
from chalkline.sources import lecture as L
from chalkline.sources.tables import table


def valid_segments(s, d):
    g = L.segments(s, d).withColumn("text", X.normalize_text(F.col("text")))
    return g.where((F.length("text") >= C.CONFIG.min_text) & X.keeps_speech(F.col("nsp"), F.col("text"))).select("video_name", F.col("id").alias("record"), "start", "end", "text")


def doc_freq_idf(s, d):
    t = valid_segments(s, d)
    f = K.document_frequency(K.term_counts(t, ["video_name", "record"], "text"), t, "video_name")
    return f.select("video_name", "token", "df", F.round("idf", 6).alias("idf"))


def tfidf_norm(s, d):
    return K.tfidf(valid_segments(s, d), "video_name", "record", "text").select("record", "token", F.round("w", 6).alias("w"))


def _keywords(s, d):
    """Keywords of each topic from the segments that lie wholly in it."""
    t, k = valid_segments(s, d), L.knowledge(s, d)
    counts = K.term_counts(t, ["video_name", "record"], "text")
    inside = contained(t.withColumnRenamed("record", "id"), k, "video_name").select("video_name", F.col("id").alias("record"), F.col("outer_id").alias("id"))
    per = counts.join(shuffled(inside), ["video_name", "record"]).groupBy("video_name", "id", "token").agg(F.sum("c").alias("c"))
    return K.keywords(k, ["video_name", "id"], per, K.document_frequency(counts, t, "video_name"), "video_name")


def keywords_topk(s, d):
    return _keywords(s, d).select("id", F.array_join("keywords", "|").alias("keywords"))


def titles(s, d):
    clean = F.filter(F.transform("keywords", lambda x: F.regexp_replace(X.strip(x), r'[<>:"/\\|?*\x00-\x1f]+', "")), lambda x: x != "")
    t = F.array_join(F.slice(clean, 1, C.CONFIG.title_words), "_")
    k = numbered(L.knowledge(s, d).select("video_name", "start", "id"), "video_name", ["start", "id"], "start").select("id", (F.col("idx") + 1).alias("n"))
    return _keywords(s, d).join(k, "id").select("id", F.when(t != "", t).otherwise(F.concat(F.lit("片段"), F.col("n").cast("string"))).alias("title"))


def text_preview(s, d, cfg=C.CONFIG):
    """The beginning of what is said in each topic, by the segments that lie wholly in it, in order of start."""
    t, k = valid_segments(s, d).withColumnRenamed("record", "id"), L.knowledge(s, d)
    inside = contained(t, k, "video_name").join(t.select("id", "start", "text"), "id")
    # a segment has at least one letter and a space, so no more of them can show
    w = Window.partitionBy("video_name", "outer_id").orderBy("start", "id")
    first = inside.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cfg.preview_text)
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]), " ")
    both = k.select("id").join(first.groupBy(F.col("outer_id").alias("id")).agg(told.alias("t")), "id", "left")
    return both.select("id", F.substring(F.coalesce("t", F.lit("")), 1, cfg.preview_text).alias("text_preview"))


def shifts(s, d):
    t = valid_segments(s, d)
    rows = numbered(t, "video_name", ["start", "record"], "start").select("video_name", "record", "idx", "start")
    rows = materialise(rows)
    got = K.shift_scores(rows.select("video_name", "record", "idx"), K.tfidf(t, "video_name", "record", "text"), "video_name")
    return got.join(shuffled(rows), ["video_name", "idx"]).select("video_name", "idx", F.col("start").alias("time"), F.round("score", 6).alias("score"))


def semantic_boundary_score(s, d):
    return shifts(s, d)


def candidates(s, d, cfg=C.CONFIG):
    a = shifts(s, d).where(F.col("score") > cfg.boundary).select("video_name", "time", F.lit(0).alias("rank"), "score")
    b = L.slides(s, d).select("video_name", "time").distinct().select("video_name", "time", F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    return a.unionByName(b)


def merge_candidates(s, d):
    return B.merge_candidates(candidates(s, d), "video_name").select("video_name", "time", "rank", "score")


def _ends(s, d):
    o = F.struct("start", "record")
    return valid_segments(s, d).groupBy("video_name").agg(F.min_by("start", o).alias("t_start"), F.max_by("end", o).alias("t_end"))


def normalize_boundaries(s, d):
    return B.normalize_boundaries(B.merge_candidates(candidates(s, d), "video_name"), _ends(s, d), "video_name")


def topics(s, d):
    """The topics between consecutive normalised boundaries, numbered from 0."""
    b = materialise(normalize_boundaries(s, d)).withColumn("_shard", F.floor(F.col("pos") / 1000))
    return sharded_scan(b, ["video_name"], "_shard", ["pos"], {"end": ("after", F.col("time"))}).where("end is not null").select(
        "video_name", (F.col("pos") - 1).alias("id"), F.col("time").alias("start"), "end", F.round(F.col("end") - F.col("time"), 2).alias("duration")
    )


def detect_topics(s, d):
    return topics(s, d)


def post_process_boundaries(s, d):
    t = L.timeline(s, d)
    p = t.select("video_name", "id", "time", "boundary", "slide", F.round(X.boundary_score(F.col("silent"), F.col("slide"), F.col("confidence")), 6).alias("score"))
    last = p.groupBy("video_name", "time").agg(F.max_by("score", "id").alias("score"), F.bool_or(F.col("boundary") | F.col("slide")).alias("mark"))
    return B.post_process(last.where("mark").select("video_name", "time", "score"), last.select("video_name", "time", "score"), "video_name")


def smooth_labels(s, d):
    return P.smooth_labels(L.segments(s, d), "video_name").select("id", "speaker")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _voiced(s, d, e):
    """The segments with the columns of ``e`` (vec_id, ...), whose voices go round."""
    n = table(s, d, "embeddings").agg((F.max("vec_id") + 1).alias("m"))
    g = L.segments(s, d).join(F.broadcast(n), how="cross").withColumn("vec_id", F.col("id") % F.col("m"))  # one row
    return g.join(e, "vec_id")


def voiceprint_relabel(s, d):
    g = _voiced(s, d, _vectors(s, d)).select("video_name", "id", "start", "end", "speaker", F.col("teacher_prob").alias("prob"), "vector")
    return P.relabel(g, "video_name").select("id", "speaker")


def diarize(s, d, cfg=C.CONFIG):
    """Speaker and probability of every segment from its length, steadiness and wording; then smoothing, voices, smoothing.

    A segment of 0.4 s or more is judged by itself, a shorter one takes over from the nearest of these. Steadiness is the variance
    of the voice vector. In a recording with fewer than two segments, or two that are long enough, all are the teacher's, without a probability.
    Steadiness is worked out once a vector; the vector itself, half a kilobyte, joins its segments only where voices are compared.
    """
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    spread = lambda v: mean(F.transform(v, lambda x: x * x)) - mean(v) * mean(v)
    long = F.round(F.col("end") - F.col("start"), 6) >= cfg.shortest_voice
    steady = _vectors(s, d).select("vec_id", spread(F.col("vector")).alias("unsteady"))
    g = materialise(_voiced(s, d, steady).withColumn("dur", F.col("end") - F.col("start")).withColumn("talk", X.teacher_talk_score(F.col("text"))).select("video_name", "id", "vec_id", "start", "end", "dur", "unsteady", "talk"))
    enough = g.groupBy("video_name").agg((F.count_if(long) >= 2).alias("enough"))
    few = g.join(enough, "video_name").where("not enough").select("id", F.lit(None).cast("double").alias("prob"), F.lit(C.TEACHER).alias("speaker"))
    g = materialise(g.join(enough.where("enough"), "video_name").drop("enough"))
    valid = S.zscore(g.where(long), "video_name", ["dur", "unsteady", "talk"])
    score = cfg.acoustic_weight * (0.5 * F.col("z_dur") - 0.5 * F.col("z_unsteady")) + cfg.text_weight * F.col("z_talk")
    prob = S.robust_logistic(valid.withColumn("score", F.round(score, 9)), "video_name", "score", cfg.center_quantile, cfg.bias).select("id", F.round("prob", 4).alias("p"), F.lit(True).alias("sure"))
    rows = materialise(numbered(materialise(g.join(prob, "id", "left")), "video_name", ["start", "id"], "start"))
    v = rows.where("sure").select("video_name", F.col("idx").cast("double").alias("at"), F.col("p").alias("v"))
    got = as_of(rows.select("video_name", F.col("idx").cast("double").alias("time"), "id", "start", "end", "vec_id"), {"v": (v, "at", ["at", "v"])}, both=True)
    b, a = F.col("v"), F.col("v_after")
    near = F.when(a.isNull() | (F.col("time") - b["at"] <= a["at"] - F.col("time")), F.coalesce(b, a)).otherwise(a)["v"]
    named = got.withColumn("prob", near).withColumn("speaker", F.when(F.col("prob") >= cfg.teacher_prob, C.TEACHER).otherwise(C.STUDENT))
    named = materialise(named)
    one = materialise(P.smooth_labels(named, "video_name").select("id", "speaker"))  # this and the next are read twice
    two = materialise(P.relabel(named.drop("speaker").join(one, "id").join(_vectors(s, d), "vec_id").select("video_name", "id", "start", "end", "speaker", "prob", "vector"), "video_name").select("id", "speaker"))
    three = P.smooth_labels(named.drop("speaker").join(two, "id"), "video_name").select("id", F.col("speaker"))
    # smoothed again only where the voices changed something
    both = materialise(one.withColumnRenamed("speaker", "was").join(two, "id").join(named.select("id", "video_name"), "id"))
    changed = both.where("was <> speaker").select("video_name").distinct().withColumn("changed", F.lit(True))
    final = three.withColumnRenamed("speaker", "again").join(both.join(changed, "video_name", "left"), "id").select("id", F.when(F.col("changed"), F.col("again")).otherwise(F.col("speaker")).alias("speaker"))
    return named.select("id", "prob").join(final, "id").select("id", "prob", "speaker").unionByName(few)


_VAL = f"v0 AS (SELECT video_name, id, \"start\", \"end\", nsp, {_norm('text')} AS text FROM seg), v AS (SELECT * FROM v0 WHERE length(text) >= 5 AND {KEEP})"
_TOK = f"""{_VAL}, {SEGMENT('v', 'video_name, id')}, tk AS (SELECT * FROM tk0 WHERE {VALID}),
tf AS (SELECT video_name, id, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY video_name, id) AS total FROM tk GROUP BY 1, 2, 3),
dn AS (SELECT video_name, count(*) AS n FROM v GROUP BY 1),
df AS (SELECT video_name, token, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN dn USING (video_name) GROUP BY 1, 2)"""
_W = """w0 AS (SELECT video_name, id, token, c / total * idf AS w FROM tf JOIN df USING (video_name, token)), w AS (SELECT video_name, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY video_name, id)) AS w FROM w0)"""
_KEY = """kk AS (SELECT kno.video_name, kno.id AS ks, v.id FROM v JOIN kno ON kno.video_name = v.video_name AND v."start" >= kno."start" AND v."end" <= kno."end"),
kc AS (SELECT kk.video_name, ks, token, sum(c) AS c FROM kk JOIN tf ON tf.video_name = kk.video_name AND tf.id = kk.id GROUP BY 1, 2, 3),
kt AS (SELECT kc.*, idf, coalesce(df, 0) >= 2 AS ok, sum(c) OVER p AS total, bool_or(coalesce(df, 0) >= 2) OVER p AS found FROM kc LEFT JOIN df USING (video_name, token) WINDOW p AS (PARTITION BY video_name, ks)),
kr AS (SELECT *, row_number() OVER (PARTITION BY ks ORDER BY round(c / total * CASE WHEN ok THEN idf ELSE 1 END, 9) DESC, length(token) DESC, token) AS r FROM kt WHERE ok OR NOT found),
kw AS (SELECT ks, list(token ORDER BY r) AS kws FROM kr WHERE r <= 5 GROUP BY ks)"""
_SHIFT = f"""{_TOK}, {_W}, rn AS (SELECT video_name, id, "start", row_number() OVER (PARTITION BY video_name ORDER BY "start", id) - 1 AS idx, count(*) OVER (PARTITION BY video_name) AS n FROM v),
wi AS (SELECT w.video_name, idx, token, w FROM w JOIN rn ON rn.id = w.id),
pl AS (SELECT video_name, idx, "start" AS time FROM rn WHERE idx >= 3 AND idx < n - 3),
sd AS (SELECT p.video_name, p.idx, token, coalesce(sum(w) FILTER (wi.idx < p.idx), 0) AS l, coalesce(sum(w) FILTER (wi.idx >= p.idx), 0) AS r FROM pl p JOIN wi ON wi.video_name = p.video_name AND wi.idx BETWEEN p.idx - 3 AND p.idx + 2 GROUP BY 1, 2, 3),
sc AS (SELECT video_name, idx, sum(l * r) / nullif(sqrt(sum(l * l) * sum(r * r)), 0) AS cos FROM sd GROUP BY 1, 2),
sh AS (SELECT pl.video_name, pl.idx, time, round(1 - coalesce(cos, 0), 6) AS score FROM pl LEFT JOIN sc USING (video_name, idx))"""
_CAND = f"""{_SHIFT}, cn AS (SELECT video_name, time, 0 AS rank, score FROM sh WHERE score > 0.35 UNION ALL SELECT DISTINCT video_name, time, 1, 0.5 FROM sli),
co AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY time, rank) AS o FROM cn),
mg AS (SELECT video_name, o, time, rank, score, 1 AS g FROM co WHERE o = 1 UNION ALL
  SELECT c.video_name, c.o, CASE WHEN c.time - m.time > 22.5 OR c.score > m.score THEN c.time ELSE m.time END, CASE WHEN c.time - m.time > 22.5 OR c.score > m.score THEN c.rank ELSE m.rank END,
    CASE WHEN c.time - m.time > 22.5 OR c.score > m.score THEN c.score ELSE m.score END, m.g + CASE WHEN c.time - m.time > 22.5 THEN 1 ELSE 0 END
  FROM mg m JOIN co c ON c.video_name = m.video_name AND c.o = m.o + 1),
mc AS (SELECT video_name, time, rank, score FROM mg QUALIFY row_number() OVER (PARTITION BY video_name, g ORDER BY o DESC) = 1)"""
_NORM = f"""{_CAND}, en AS (SELECT video_name, arg_min("start", struct_pack(a := "start", b := id)) AS ts, arg_max("end", struct_pack(a := "start", b := id)) AS te FROM v GROUP BY 1),
bo AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY time) AS o FROM (SELECT DISTINCT mc.video_name, time FROM mc JOIN en USING (video_name) WHERE time > ts + 1e-6)),
nb AS (SELECT video_name, 0 AS o, round(ts, 2) AS last, [round(ts, 2)] AS out FROM en UNION ALL
  SELECT n.video_name, b.o, CASE WHEN b.time - n.last < 45 THEN n.last ELSE round(b.time, 2) END,
    CASE WHEN b.time - n.last < 45 THEN [] ELSE list_append(list_transform(range(1, CASE WHEN b.time - n.last > 1200 THEN CAST(floor((b.time - n.last) / 1200) AS BIGINT) + 1 ELSE 1 END),
      lambda k: list_reduce(list_concat([n.last], list_transform(range(k), lambda z: (b.time - n.last) / (floor((b.time - n.last) / 1200) + 1))), lambda p, q: round(p + q, 2))), round(b.time, 2)) END
  FROM nb n JOIN bo b ON b.video_name = n.video_name AND b.o = n.o + 1),
nx AS (SELECT video_name, o, unnest(out) AS time FROM nb),
nl AS (SELECT video_name, max(time) AS last FROM nx GROUP BY 1),
nf AS (SELECT video_name, time, 0 AS z FROM nx UNION ALL SELECT video_name, round(te, 2), 1 FROM en JOIN nl USING (video_name) WHERE abs(last - round(te, 2)) >= 1e-6),
fb AS (SELECT video_name, row_number() OVER (PARTITION BY video_name ORDER BY z, time) AS pos, time FROM nf)"""
_SMOOTH = """so AS (SELECT *, row_number() OVER w AS o, count(*) OVER (PARTITION BY video_name) AS n,
  list_filter([lead(speaker, 1) OVER w, lead(speaker, 2) OVER w, lead(speaker, 3) OVER w], lambda x: x IS NOT NULL) AS ahead FROM seg WINDOW w AS (PARTITION BY video_name ORDER BY "start", id)),
sm AS (SELECT video_name, 0 AS o, CAST(NULL AS BIGINT) AS id, CAST([] AS VARCHAR[]) AS back, CAST(NULL AS VARCHAR) AS speaker FROM (SELECT DISTINCT video_name FROM seg) UNION ALL
  SELECT video_name, o, id, list_append(back, lab)[-3:], lab FROM (
    SELECT video_name, o, id, back, CASE WHEN round("end" - "start", 6) > 4 OR n <= 2 OR len(ne) < 2 OR t = u OR greatest(t, u) < 2 THEN speaker WHEN t > u THEN '教师' ELSE '学生' END AS lab FROM (
      SELECT *, len(list_filter(ne, lambda x: x = '教师')) AS t, len(list_filter(ne, lambda x: x = '学生')) AS u FROM (
        SELECT s.video_name, s.o, s.id, s."start", s."end", s.n, s.speaker, m.back, list_concat(m.back, s.ahead) AS ne FROM sm m JOIN so s ON s.video_name = m.video_name AND s.o = m.o + 1))))"""
_VOICE = """em AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), eu AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM em),
g AS (SELECT *, id % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id, coalesce(teacher_prob, 0) AS p FROM seg),
te AS (SELECT * FROM g WHERE speaker = '教师'), bd AS (SELECT video_name, least(0.6, greatest(0.28, quantile_cont(p, 0.65))) AS b FROM te GROUP BY 1),
tm AS (SELECT te.*, p >= b AS sure, count(*) FILTER (p >= b) OVER (PARTITION BY video_name) AS ns, count(*) OVER (PARTITION BY video_name) AS na, row_number() OVER (PARTITION BY video_name ORDER BY p DESC, "start", id) AS k FROM te JOIN bd USING (video_name)),
vo AS (SELECT video_name, vec_id FROM tm WHERE (ns >= 2 AND sure) OR (ns < 2 AND k <= 3 AND na >= 2)),
tp AS (SELECT video_name, i, avg(x) AS x FROM vo JOIN eu USING (vec_id) GROUP BY 1, 2), sp AS (SELECT video_name, i, avg(x) AS x FROM g JOIN eu USING (vec_id) WHERE speaker = '学生' AND p <= 0.28 GROUP BY 1, 2),
lt AS (SELECT g.id, round(sum(eu.x * tp.x) / sqrt(sum(eu.x * eu.x) * sum(tp.x * tp.x)), 9) AS lt FROM g JOIN eu USING (vec_id) JOIN tp ON tp.video_name = g.video_name AND tp.i = eu.i GROUP BY 1),
ls AS (SELECT g.id, round(sum(eu.x * sp.x) / sqrt(sum(eu.x * eu.x) * sum(sp.x * sp.x)), 9) AS ls FROM g JOIN eu USING (vec_id) JOIN sp ON sp.video_name = g.video_name AND sp.i = eu.i GROUP BY 1)"""
_POST = """, a AS (SELECT video_name, time, arg_max(round(CASE WHEN silent THEN 1.5 ELSE 0 END + CASE WHEN slide THEN 1.0 ELSE 0 END + greatest(0, 1 - confidence) * 0.5, 6), id) AS score, bool_or(boundary OR slide) AS mark FROM tl GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY time) AS o FROM a WHERE mark),
m AS (SELECT video_name, o, time, score, 1 AS g FROM o WHERE o = 1 UNION ALL
  SELECT o.video_name, o.o, CASE WHEN o.time - m.time >= 30 OR o.score > m.score THEN o.time ELSE m.time END, CASE WHEN o.time - m.time >= 30 OR o.score > m.score THEN o.score ELSE m.score END, m.g + CASE WHEN o.time - m.time >= 30 THEN 1 ELSE 0 END
  FROM m JOIN o ON o.video_name = m.video_name AND o.o = m.o + 1),
k AS (SELECT video_name, time FROM m QUALIFY row_number() OVER (PARTITION BY video_name, g ORDER BY o DESC) = 1),
gp AS (SELECT video_name, lag(time) OVER (PARTITION BY video_name ORDER BY time) AS fr, time AS until FROM k),
sp AS (SELECT video_name, fr, until, false AS stop FROM gp WHERE until - fr > 600 UNION ALL
  SELECT video_name, cut, until, until - cut < 30 FROM (
    SELECT video_name, until, CASE WHEN b - fr < 30 THEN round(fr + 30, 2) ELSE b END AS cut FROM (
      SELECT s.video_name, s.fr, s.until, (SELECT arg_max(a.time, struct_pack(x := a.score, y := -a.time)) FROM a WHERE a.video_name = s.video_name AND a.time BETWEEN s.fr AND s.until) AS b FROM sp s WHERE NOT stop AND s.until - s.fr > 600)))
SELECT DISTINCT video_name, time FROM (SELECT video_name, round(time, 2) AS time FROM k UNION ALL SELECT video_name, round(fr, 2) FROM sp WHERE NOT stop)"""
_R = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)
_TITLES = """coalesce(nullif(array_to_string(list_filter(list_transform(coalesce(kws, []), lambda x: regexp_replace(trim(x), '[<>:"/\\\\|?*]+', '', 'g')), lambda x: x <> '')[1:2], '_'), ''), '片段' || CAST(row_number() OVER (PARTITION BY video_name ORDER BY "start", id) AS VARCHAR))"""

_SQL = {
    "doc_freq_idf": with_views(f", {_TOK} SELECT video_name, token, df, round(idf, 6) AS idf FROM df", "seg"),
    "tfidf_norm": with_views(f", {_TOK}, {_W} SELECT id AS record, token, round(w, 6) AS w FROM w", "seg"),
    "keywords_topk": with_views(f", {_TOK}, {_KEY} SELECT kno.id, array_to_string(coalesce(kws, []), '|') AS keywords FROM kno LEFT JOIN kw ON kw.ks = kno.id", "seg", "kno"),
    "titles": with_views(f", {_TOK}, {_KEY} SELECT id, {_TITLES} AS title FROM kno LEFT JOIN kw ON kw.ks = kno.id", "seg", "kno"),
    "text_preview": with_views(f""", {_VAL}, c AS (SELECT kno.id, string_agg(text, ' ' ORDER BY v."start", v.id) AS t FROM v JOIN kno ON kno.video_name = v.video_name AND v."start" >= kno."start" AND v."end" <= kno."end" GROUP BY kno.id)
SELECT kno.id, substring(coalesce(t, ''), 1, 120) AS text_preview FROM kno LEFT JOIN c ON c.id = kno.id""", "seg", "kno"),
    "semantic_boundary_score": with_views(f", {_SHIFT} SELECT * FROM sh", "seg"),
    "merge_candidates": _R(with_views(f", {_CAND} SELECT * FROM mc", "seg", "sli")),
    "normalize_boundaries": _R(with_views(f", {_NORM} SELECT * FROM fb", "seg", "sli")),
    "detect_topics": _R(with_views(f""", {_NORM} SELECT * FROM (SELECT video_name, pos - 1 AS id, time AS "start", lead(time) OVER (PARTITION BY video_name ORDER BY pos) AS "end", round(lead(time) OVER (PARTITION BY video_name ORDER BY pos) - time, 2) AS duration FROM fb) WHERE "end" IS NOT NULL""", "seg", "sli")),
    "post_process_boundaries": _R(with_views(_POST, "tl")),
    "smooth_labels": _R(with_views(f", {_SMOOTH} SELECT id, speaker FROM sm WHERE o > 0", "seg")),
    "voiceprint_relabel": with_views(f""", {_VOICE} SELECT g.id, CASE WHEN speaker = '学生' AND p BETWEEN 0.28 AND 0.6 AND round("end" - "start", 6) BETWEEN 0.8 AND 40 AND lt >= 0.82 AND (ls IS NULL OR lt - ls >= 0.03) THEN '教师' ELSE speaker END AS speaker
FROM g LEFT JOIN lt USING (id) LEFT JOIN ls USING (id)""", "seg"),
}


def queries() -> dict:
    # diarize composes the queries above; it has no SQL of its own
    return {n: globals()[n] for n in (*_SQL, "diarize")}


def oracle_sql() -> dict[str, str]:
    return _SQL
