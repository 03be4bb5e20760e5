"""Media listings and nested JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO_FILES = "*.{mp4,avi,mov,mkv,flv,wmv,MP4}"
TIMELINE_DOCUMENT = "video_name string, part bigint, total_points bigint, time_series array<struct<time double, id bigint, silent boolean, speaker string>>"


def find_files(spark: SparkSession, folder: str, pattern: str = VIDEO_FILES, to: str = "output") -> DataFrame:
    """``(path, stem, output_dir, bytes, size_mb)`` of the files below ``folder`` that match, each once; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select("path", stem.alias("stem"), F.concat(F.lit(f"{to}/"), stem).alias("output_dir"), F.col("length").alias("bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb")).distinct()


def write_timeline_documents(points: DataFrame, to: str, hours: int = 6) -> None:
    """JSON documents of a recording's points in order of time, one a part of ``hours``, so that no recording is one row."""
    series = F.sort_array(F.collect_list(F.struct("time", "id", "silent", "speaker")))
    part = F.floor(F.col("time") / (3600 * hours)).alias("part")
    points.groupBy("video_name", part).agg(F.count("*").alias("total_points"), series.alias("time_series")).write.mode("overwrite").json(to)


def read_timeline_documents(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The points of JSON documents; a required input that is empty is an error."""
    documents = spark.read.schema(TIMELINE_DOCUMENT).json(path)
    if required and documents.isEmpty():
        raise FileNotFoundError(f"no documents in {path}")
    return documents.select("video_name", F.explode("time_series").alias("p")).select("video_name", "p.*")
