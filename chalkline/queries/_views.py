"""The recording tables for the SQL side, as chalkline.sources.lecture gives them."""

_LATEST = "SELECT * FROM {t} WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY ingested_at DESC NULLS LAST) = 1"

ROLE = """CASE WHEN lower(regexp_replace({c}, '[\\s:：]+', '', 'g')) IN ('teacher', 'lecturer', 't', '教师', '老师', '讲师') THEN '教师'
  WHEN lower(regexp_replace({c}, '[\\s:：]+', '', 'g')) IN ('student', 's', 'ｓｔｕｄｅｎｔ', '学生', '学员', '同学') THEN '学生' ELSE '未知' END"""

SAMPLES = f"""SELECT video_name, sample_id AS id, time, coalesce(in_podium, true) AS in_podium,
  CASE WHEN motion_ratio BETWEEN 0 AND 1 THEN motion_ratio ELSE 0 END AS motion_ratio,
  coalesce(static_person_detected, false) AS static_person, coalesce(full_screen_ppt, false) AS full_screen
  FROM ({_LATEST.format(t='teacher_timeline', k='sample_id')}) WHERE video_name IS NOT NULL AND time IS NOT NULL"""
SLIDES = f"""SELECT video_name, content_id AS id, time, coalesce(slide_idx, 0) AS slide_idx, coalesce(text, '') AS text
  FROM ({_LATEST.format(t='ppt_content', k='content_id')}) WHERE video_name IS NOT NULL AND time IS NOT NULL"""
SEGMENTS = f"""SELECT video_name, seg_id AS id, "start", greatest("start", coalesce("end", "start")) AS "end", coalesce(text, '') AS text,
  CASE WHEN NOT isnan(no_speech_prob) THEN no_speech_prob END AS nsp,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END AS confidence, {ROLE.format(c='speaker')} AS speaker,
  CASE WHEN NOT isnan(teacher_prob) THEN teacher_prob END AS teacher_prob
  FROM ({_LATEST.format(t='speech_segments', k='seg_id')}) WHERE video_name IS NOT NULL AND "start" IS NOT NULL"""
KNOWLEDGE = f"""SELECT video_name, ks_id AS id, "start", "end", coalesce(title, '') AS title, coalesce(keywords, []) AS keywords
  FROM ({_LATEST.format(t='knowledge_segments', k='ks_id')}) WHERE video_name IS NOT NULL AND "start" < "end" """
TIMELINE = f"""SELECT video_name, point_id AS id, time, coalesce(teacher_present, true) AS present,
  CASE WHEN motion_ratio BETWEEN 0 AND 1 THEN motion_ratio ELSE 0 END AS motion, coalesce(slide_idx, 0) AS slide_idx,
  coalesce(ppt_text, '') AS ppt_text, coalesce(is_slide_transition, false) AS slide, coalesce(speech_text, '') AS speech_text,
  {ROLE.format(c='speaker')} AS speaker, CASE WHEN speech_confidence IS NULL OR isnan(speech_confidence) THEN 0 ELSE speech_confidence END AS confidence,
  coalesce(is_silence, true) AS silent, coalesce(is_knowledge_boundary, false) AS boundary
  FROM (SELECT * FROM time_series WHERE video_name IS NOT NULL AND time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_name, point_id) = 1)"""

VIEWS = {"sam": SAMPLES, "sli": SLIDES, "seg": SEGMENTS, "kno": KNOWLEDGE, "tl": TIMELINE}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the named views; it may go on with a comma and views of its own."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql


SILENCE = "CASE WHEN nsp IS NULL OR nsp = 0 THEN 1.0 ELSE nsp END"
STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
KEEP = f"(({SILENCE}) <= 0.8 OR (length({STRIP.format(c='text')}) > 3))"
