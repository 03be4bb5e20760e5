"""Labels, models and their evaluation on timeline points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chalkline.functions.config import CONFIG
from chalkline.operators.alignment import with_spans
from chalkline.operators.features import FEATURES
from chalkline.operators.forests import Forest, grow
from chalkline.operators.periods import merge_intervals
from chalkline.operators.stats import boundary_threshold


def point_labels(points: DataFrame, annotations: DataFrame, tolerance: float = 3.0, keep: Sequence[str] = ()) -> DataFrame:
    """``(video_name, id, time, keep, boundary, interference)``, the last two as 0 or 1, for timeline points.

    A boundary lies within ``tolerance`` of the start or end of an annotated topic. Interference
    is an annotated stretch of it and, where a recording has topics, all time outside them.
    """
    ranges = lambda which: merge_intervals(annotations.where(which), ["video_name"]).select(
        "video_name", (F.col("from_ms") / 1000).alias("a"), (F.col("to_ms") / 1000).alias("b")
    )
    ends = annotations.where("not is_interference").select("video_name", F.explode(F.array("start", "end")).alias("a")).select("video_name", F.col("a").cast("double").alias("a")).distinct()
    topics = ranges("not is_interference")
    spans = lambda t, kind: t.select("video_name", F.lit(kind).alias("_kind"), "a", "b")
    # a second more than the tolerance: distances are rounded
    near = ends.select("video_name", F.lit("e").alias("_kind"), (F.col("a") - tolerance - 1).alias("a"), (F.col("a") + tolerance + 1).alias("b"))
    here = spans(topics, "k").unionByName(spans(ranges("is_interference"), "x")).unionByName(near)
    has_topics = topics.select("video_name").distinct().withColumn("_topics", F.lit(True))  # no more than the annotations
    t = F.col("time").cast("double")
    placed = [c for c in points.columns if c == "_shard"]
    rows = points.where("video_name is not null and time is not null").select("video_name", "id", t.alias("time"), *keep, *placed)
    got = with_spans(rows, here, "video_name", "kxe").join(has_topics, "video_name", "left")
    any_of = lambda k, f: F.coalesce(F.exists(f"_{k}", f), F.lit(False))
    inside = lambda k: any_of(k, lambda r: F.col("time").between(r["a"], r["b"]))
    return got.select(
        "video_name", "id", "time", *keep, any_of("e", lambda r: F.round(F.abs(F.col("time") - (r["a"] + r["b"]) / 2), 6) <= tolerance).cast("int").alias("boundary"),
        (inside("x") | (F.coalesce("_topics", F.lit(False)) & ~inside("k"))).cast("int").alias("interference"),
    )


def train_forests(rows: DataFrame, label: str, group: str, trees: int = 200, depth: int = 8, seed: int = 42, positive: float = CONFIG.positive_weight) -> dict[int, Forest]:
    """A random forest with balanced weights for each whole number of ``group``; none where one class has fewer than two rows.

    Features are not scaled: that keeps their order, which is all a tree goes by.
    """
    counts = {(r[group], r[label]): r["n"] for r in rows.groupBy(group, label).agg(F.count("*").alias("n")).collect()}  # two rows a group
    weights = {}
    for g in sorted({k for k, _ in counts}):
        zero, one = counts.get((g, 0), 0), counts.get((g, 1), 0)
        if min(zero, one) >= 2:
            weights[g] = ((zero + one) / (2 * zero), (zero + one) / (2 * one) * positive)
    return grow(rows, group, label, weights, ["video_name", "id"], list(FEATURES), trees, depth, seed) if weights else {}


def train_forest(rows: DataFrame, label: str, trees: int = 200, depth: int = 8, seed: int = 42, positive: float = CONFIG.positive_weight) -> Forest | None:
    """One forest of all rows, or None."""
    return train_forests(rows.withColumn("_all", F.lit(0)), label, "_all", trees, depth, seed, positive).get(0)


def ensemble_scores(rows: DataFrame, models: Sequence[Forest], keys: list[str]) -> DataFrame:
    """``(keys, score)`` for each row: the mean of the models' probabilities of the positive class."""
    given = rows.select(*keys, *(F.col(c).cast("double").alias(f"_{c}") for c in FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[len(keys) :]]
            score = np.mean([m.scores(columns) for m in models], axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(score)], names=[*keys, "score"])

    return given.mapInArrow(run, StructType([*given.schema.fields[: len(keys)], StructField("score", DoubleType())]))


def boundary_hits(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Times whose score reaches their recording's own threshold, and those the rules mark."""
    ratios = points.groupBy("video_name").agg(F.avg(F.col("slide").cast("int")).alias("a"), F.avg(F.col("silent").cast("int")).alias("b"))
    joined = points.join(scores, ["video_name", "id"]).join(ratios, "video_name")
    return joined.where((F.col("score") >= boundary_threshold(F.col("a"), F.col("b"))) | F.col("boundary")).select("video_name", F.round("time", 2).alias("time")).distinct()


def save_model(spark: SparkSession, model: Forest, folder: str, scope: str, kind: str) -> str:
    """The model under ``folder/scope/kind``, replacing what is there: a row of limits for each feature, then one for each tree."""
    to = f"{folder}/{scope}/{kind}"
    rows = [(False, k, [float(x) for x in e], [], []) for k, e in enumerate(model.edges)]
    rows += [(True, k, v.tolist(), f.tolist(), [int(x) for x in b]) for k, (f, b, v) in enumerate(zip(model.feature, model.bin, model.value))]
    spark.createDataFrame(rows, "tree boolean, place int, value array<double>, feature array<int>, bin array<int>").coalesce(1).write.mode("overwrite").parquet(to)
    return to


def load_model(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(path).orderBy("tree", "place").collect()
    t = [r for r in rows if r["tree"]]
    return Forest([r["value"] for r in rows if not r["tree"]], np.array([r["feature"] for r in t], np.int32), np.array([r["bin"] for r in t], np.uint8), np.array([r["value"] for r in t]))


def load_models(spark: SparkSession, paths: Sequence[str]) -> list[Forest]:
    """The models that can be read, in order of path; none at all is an error."""
    found = []
    for p in sorted(paths):
        try:
            found.append(load_model(spark, p))
        except Exception as e:  # noqa: BLE001 - a broken model is left out, whatever broke it
            print(f"left out {p}: {type(e).__name__}")
    if not found:
        raise FileNotFoundError("no readable model")
    return found


def bounds_inside(model_times: DataFrame, ends: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Model boundaries (video_name, time) strictly inside (t_start, t_end), to be added to the rule boundaries."""
    return model_times.join(ends, "video_name").where((F.col("time") > F.col("t_start") + eps) & (F.col("time") < F.col("t_end") - eps)).select("video_name", "time")
