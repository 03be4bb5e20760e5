"""The recording tables as the analysis wants them: valid versions, usable times, defaults for what is missing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.text import speaker_role
from chalkline.operators.alignment import ordered
from chalkline.operators.versions import latest_version
from chalkline.sources.tables import table


def _number(name: str, default: float = 0.0):
    return F.coalesce(F.nanvl(F.col(name), F.lit(default)), F.lit(default))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["video_name", "time", "in_podium", "motion_ratio", "static_person_detected", "full_screen_ppt"]
    motion = F.when(F.col("motion_ratio").between(0, 1), F.col("motion_ratio")).otherwise(0.0)
    return (
        latest_version(table(spark, folder, "teacher_timeline"), "sample_id", cols)
        .where("video_name is not null and time is not null")
        .select("video_name", F.col("sample_id").alias("id"), "time", F.coalesce("in_podium", F.lit(True)).alias("in_podium"),
                motion.alias("motion_ratio"), F.coalesce("static_person_detected", F.lit(False)).alias("static_person"),
                F.coalesce("full_screen_ppt", F.lit(False)).alias("full_screen"))
    )


def slides(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["video_name", "time", "slide_idx", "text"]
    return (
        latest_version(table(spark, folder, "ppt_content"), "content_id", cols)
        .where("video_name is not null and time is not null")
        .select("video_name", F.col("content_id").alias("id"), "time", F.coalesce("slide_idx", F.lit(0)).alias("slide_idx"), F.coalesce("text", F.lit("")).alias("text"))
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["video_name", "start", "end", "text", "no_speech_prob", "confidence", "speaker", "teacher_prob"]
    return (
        latest_version(table(spark, folder, "speech_segments"), "seg_id", cols)
        .where("video_name is not null and start is not null")
        .select("video_name", F.col("seg_id").alias("id"), "start", F.greatest("start", F.coalesce("end", "start")).alias("end"),
                F.coalesce("text", F.lit("")).alias("text"), F.nanvl("no_speech_prob", F.lit(None)).alias("nsp"),
                _number("confidence").alias("confidence"), speaker_role(F.col("speaker")).alias("speaker"),
                F.nanvl("teacher_prob", F.lit(None)).alias("teacher_prob"))
    )


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["video_name", "start", "end", "title", "keywords"]
    return (
        latest_version(table(spark, folder, "knowledge_segments"), "ks_id", cols)
        .where("video_name is not null and start < end")
        .select("video_name", F.col("ks_id").alias("id"), "start", "end", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    )


_kept: ContextVar[dict[str, DataFrame] | None] = ContextVar("points", default=None)


@contextmanager
def points_kept() -> Iterator[None]:
    """Within it the :func:`points` of a folder are written once, with all columns, for whoever asks for them."""
    token = _kept.set({})
    try:
        yield
    finally:
        _kept.reset(token)


def points(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The :func:`timeline`, or these columns of it (``video_name``, ``time`` and ``id`` among them), ``ordered`` by recording and shard."""
    kept = _kept.get()
    if kept is None:
        t = timeline(spark, folder)
        return ordered(t.select(*columns) if columns else t, "video_name")
    if folder not in kept:
        kept[folder] = ordered(timeline(spark, folder), "video_name")
    return kept[folder].select(*columns, "_shard") if columns else kept[folder]


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The aligned points, each once."""
    return (
        table(spark, folder, "time_series")
        .where("video_name is not null and time is not null and point_id is not null")
        .dropDuplicates(["video_name", "point_id"])
        .select("video_name", F.col("point_id").alias("id"), "time", F.coalesce("teacher_present", F.lit(True)).alias("present"),
                F.when(F.col("motion_ratio").between(0, 1), F.col("motion_ratio")).otherwise(0.0).alias("motion"),
                F.coalesce("slide_idx", F.lit(0)).alias("slide_idx"), F.coalesce("ppt_text", F.lit("")).alias("ppt_text"),
                F.coalesce("is_slide_transition", F.lit(False)).alias("slide"), F.coalesce("speech_text", F.lit("")).alias("speech_text"),
                speaker_role(F.col("speaker")).alias("speaker"), _number("speech_confidence").alias("confidence"),
                F.coalesce("is_silence", F.lit(True)).alias("silent"), F.coalesce("is_knowledge_boundary", F.lit(False)).alias("boundary"))
    )
