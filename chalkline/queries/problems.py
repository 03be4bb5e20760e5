"""Queries of the general training-data problems (4 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators.periods import periods_and_gaps
from chalkline.operators.regular_grid import to_grid, windows_touched
from chalkline.operators.versions import latest_version
from chalkline.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        latest_version(table(spark, folder, name), record, ["video_name", "start", "end"]).select(
            F.lit(track).alias("track"), "video_name", "start", "end"
        )
        for track, name, record in (
            ("knowledge", "knowledge_segments", "ks_id"),
            ("speech", "speech_segments", "seg_id"),
        )
    ]
    return periods_and_gaps(parts[0].unionByName(parts[1]), ["track", "video_name"])


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    readings = latest_version(
        table(spark, folder, "teacher_timeline"), "sample_id", ["video_name", "time", "motion_ratio"]
    )
    return to_grid(readings, "video_name", "time", "motion_ratio")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).where("is_missing").select("video_name", "window_no")


def p7_grid(spark: SparkSession, folder: str) -> DataFrame:
    speech = latest_version(table(spark, folder, "speech_segments"), "seg_id", ["video_name", "start", "end"])
    spoken = windows_touched(speech, "video_name", "start", "end").withColumn("spoken", F.lit(True))
    return (
        _grid(spark, folder)
        .join(spoken, ["video_name", "window_no"], "left")
        .select(
            "video_name", "window_no", "n_readings", "value", "is_missing",
            F.coalesce("spoken", F.lit(False)).alias("spoken"),
        )
    )


_LATEST = "(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY ingested_at DESC NULLS LAST) = 1)"
_SPEECH, _KNOWLEDGE, _READINGS = (
    _LATEST.format(t=t, k=k)
    for t, k in (("speech_segments", "seg_id"), ("knowledge_segments", "ks_id"), ("teacher_timeline", "sample_id"))
)

_P4 = f"""
WITH raw AS (
  SELECT 'knowledge' AS track, video_name, "start" AS a, "end" AS b FROM {_KNOWLEDGE}
  UNION ALL SELECT 'speech', video_name, "start", "end" FROM {_SPEECH}),
iv AS (
  SELECT track, video_name, CAST(round(least(a, b) * 1000) AS BIGINT) AS s, CAST(round(greatest(a, b) * 1000) AS BIGINT) AS e
  FROM raw WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND a <> b AND video_name IS NOT NULL),
m AS (
  SELECT *, max(e) OVER (PARTITION BY track, video_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track, video_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT track, video_name, min(s) AS f, max(e) AS t FROM g GROUP BY track, video_name, n),
q AS (SELECT *, lag(t) OVER (PARTITION BY track, video_name ORDER BY f) AS before FROM p)
SELECT track, video_name, 'period' AS kind, f AS from_ms, t AS to_ms FROM q
UNION ALL SELECT track, video_name, 'gap', before, f FROM q WHERE f - before <= 1800000
"""

_GRID = f"""
u AS (
  SELECT video_name, CAST(round(time * 1000) AS BIGINT) AS ms, CAST(round(motion_ratio * 1000000) AS BIGINT) AS v FROM {_READINGS}
  WHERE time IS NOT NULL AND motion_ratio BETWEEN 0 AND 1 AND NOT isnan(motion_ratio) AND video_name IS NOT NULL),
f AS (
  SELECT video_name, CAST(floor(ms / 10000) AS BIGINT) AS w, count(*) AS n, sum(v) AS s, (2000 * sum(v) + count(*)) // (2 * count(*)) AS v, min(ms) AS a, max(ms) AS z FROM u GROUP BY ALL),
h AS (
  SELECT *, lag(w) OVER o AS pw, lag(v) OVER o AS pv, lag(z) OVER o AS pz FROM f WINDOW o AS (PARTITION BY video_name ORDER BY w)),
miss AS (
  SELECT video_name, unnest(range(pw + 1, w)) AS m, pw, pv, w, v FROM h WHERE a - pz <= 1800000),
grid AS (
  SELECT video_name, w AS window_no, n AS n_readings, (2 * s + n) // (2 * n) / 1e6 AS value, false AS is_missing FROM h
  UNION ALL SELECT video_name, m, 0, (2 * (pv * (w - m) + v * (m - pw)) + 1000 * (w - pw)) // (2000 * (w - pw)) / 1e6, true FROM miss)
"""

_P7_GRID = f"""
WITH {_GRID},
said AS (
  SELECT DISTINCT video_name, unnest(range(
    CAST(floor(round(least("start", coalesce("end", "start")) * 1000) / 10000) AS BIGINT),
    CAST(floor(round(greatest("start", coalesce("end", "start")) * 1000) / 10000) AS BIGINT) + 1)) AS window_no
  FROM {_SPEECH} WHERE "start" IS NOT NULL)
SELECT g.video_name, g.window_no, g.n_readings, g.value, g.is_missing, s.window_no IS NOT NULL AS spoken
FROM grid g LEFT JOIN said s ON s.video_name = g.video_name AND s.window_no = g.window_no
"""


def queries() -> dict:
    return {"p4_found": p4_found, "p7_found": p7_found, "p7_grid": p7_grid}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p7_found": f"WITH {_GRID} SELECT video_name, window_no FROM grid WHERE is_missing",
        "p7_grid": _P7_GRID,
    }
