"""Decisions on measured frames: the ratios and boxes are given, the pixels stay outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.config import CONFIG
from chalkline.operators.alignment import SHARD_S, numbered
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise


def is_full_screen(bright: Column, pale: Column, edges: Column) -> Column:
    """Much bright, much unsaturated and some edges."""
    return (bright > 0.35) & (pale > 0.45) & (edges > 0.005)


def is_present(motion: Column, static_person: Column, full_screen: Column, least: float = CONFIG.presence_motion) -> Column:
    return (motion > least) | static_person | full_screen


def cached_detection(samples: DataFrame, key: str, order: list[str], needed: Column, found: Column, every: int = 2) -> DataFrame:
    """``samples`` with ``detected``: what the costly detector says, which is asked only where ``needed``, and there not each time.

    In a run of samples that need it the detector is asked at the first and at those whose number in the recording is a
    multiple of ``every``; the others take over its last answer. Where it isn't needed the answer is no, and is forgotten.
    ``samples`` needs (key, time) and the columns of ``order``, which begins with the time.
    """
    rows = numbered(samples.withColumns({"_need": F.coalesce(needed, F.lit(False)), "_found": F.coalesce(found, F.lit(False))}), key, order, order[0])
    placed = materialise(rows.withColumn("_shard", F.floor(F.col(order[0]) / SHARD_S)))
    before = sharded_scan(placed, [key], "_shard", order, {"_was": ("before", F.col("_need"))})
    asked = F.col("_need") & (~F.coalesce("_was", F.lit(False)) | (F.col("idx") % every == 0))
    seen = before.withColumn("_asked", asked)
    got = sharded_scan(seen, [key], "_shard", order, {"_last": ("before", F.when(F.col("_asked"), F.col("_found")))})
    answer = F.when(F.col("_asked"), F.col("_found")).when(F.col("_need"), F.coalesce("_last", F.lit(False))).otherwise(False)
    return got.withColumn("detected", answer).drop("_need", "_found", "_was", "_asked", "_last", "_shard", "idx")


def crop(pixels: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The part of an image, an array of rows, between fractions of its width and height."""
    at = lambda n, f: F.floor(n * f).cast("int")
    h, w = F.size(pixels), F.size(F.get(pixels, F.lit(0)))
    rows = F.slice(pixels, at(h, top) + 1, at(h, bottom) - at(h, top))
    return F.transform(rows, lambda r: F.slice(r, at(w, left) + 1, at(w, right) - at(w, left)))


def frame_statistics(frames: Column) -> Column:
    """Mean, deviation (of the population) and their ratio for an array of values, as a struct."""
    n = F.size(frames)
    mean = F.aggregate(frames, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(F.transform(frames, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / n
    return F.struct(mean.alias("mean"), F.sqrt(var).alias("deviation"), (F.sqrt(var) / (mean + 1e-6)).alias("variation"))


def has_person(boxes: Column, width: Column, height: Column) -> Column:
    """Any box with enough weight and area, in a crop of at least 64 by 64."""
    return (width >= 64) & (height >= 64) & F.exists(boxes, lambda b: (b["weight"] >= 0.20) & (b["area"] >= 0.015))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two grey images given as arrays of equal length."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    product = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v)) / n
    va, vb, cov = product(a, a) - ma * ma, product(b, b) - mb * mb, product(a, b) - ma * mb
    c1, c2 = 2.55**2, 7.65**2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2) + 1e-8)


def recognised_text(boxes: DataFrame, keys: list[str], order: str, text: str, confidence: str) -> DataFrame:
    """Text of the boxes that are sure enough; where none is, of those sure under the relaxed bound."""
    strict, relaxed = F.col(confidence) >= 0.15, F.col(confidence) >= max(0.08, 0.15 * 0.5)
    joined = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep & (F.col(text) != ""), F.struct(order, text)))), lambda x: x[text]), " ")
    return boxes.groupBy(*keys).agg(joined(strict).alias("_s"), joined(relaxed).alias("_r")).select(
        *keys, F.coalesce(F.nullif("_s", F.lit("")), "_r").alias("text")
    )
