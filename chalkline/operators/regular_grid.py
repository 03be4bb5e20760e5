"""Irregular readings on a regular time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.plans.scan import sharded_scan

#: Means that fills are drawn between have this many parts of the last place.
FINER = 1000


def _rounded(a: Column, b: Column) -> Column:
    """``a / b`` of whole numbers, ``b`` positive, rounded half up, in whole numbers."""
    x, y = 2 * a + b, 2 * b
    return F.call_function("div", x - F.pmod(x, y), y)


def to_grid(
    readings: DataFrame,
    key: str,
    time: str,
    value: str,
    step_s: float = 10.0,
    session_gap_s: float = 1800.0,
    lo: float = 0.0,
    hi: float = 1.0,
    shard_windows: int = 360,
    decimals: int = 6,
) -> DataFrame:
    """One row per ``key`` and window ``floor(time / step_s)`` within a session.

    Columns: ``key``, window_no, n_readings, value, is_missing. A reading is usable
    if key and time are there and its value is a number from ``lo`` to ``hi``;
    others are ignored. A window with usable readings has their mean; one without,
    between the first and last reading of a session, is marked ``is_missing`` and
    filled on the straight line between the neighbouring windows' means. A session
    ends where more than ``session_gap_s`` pass without a usable reading. Repeated
    readings count as often as they come. Empty in, empty out.

    Values count to ``decimals`` places and are added up as whole numbers of the last
    place; means and fills are divided once and rounded half up, so a result depends
    neither on the order of the rows nor on how they are spread over tasks.

    Readings are averaged per window before anything else, partial on the map side.
    A source is cut into shards of ``shard_windows``; what the last filled window of
    the earlier shards holds comes over the shards' summaries, so each shard fills
    on its own and no gap yields more than ``session_gap_s / step_s`` rows.
    """
    t, v = F.col(time).cast("double"), F.col(value).cast("double")
    usable = readings.select(F.col(key), t.alias("_t"), v.alias("_v")).where(
        F.col(key).isNotNull() & (F.abs(F.col("_t")) < 1e12) & F.col("_v").between(lo, hi) & ~F.isnan("_v")
    )
    ms = F.round(F.col("_t") * 1000).cast("bigint")
    step, unit = round(step_s * 1000), 10**decimals
    filled = (
        usable.select(key, ms.alias("_ms"), F.round(F.col("_v") * unit).cast("bigint").alias("_v"))
        .groupBy(key, F.floor(F.col("_ms") / step).cast("bigint").alias("window_no"))
        .agg(
            F.count("*").alias("n_readings"), F.sum("_v").alias("_sum"),
            F.min("_ms").alias("_first"), F.max("_ms").alias("_last"),
        )
        .withColumn("_fine", _rounded(F.col("_sum") * FINER, F.col("n_readings")))
        .withColumn("_shard", F.floor(F.col("window_no") / shard_windows))
    )
    last = F.struct(F.col("window_no").alias("w"), F.col("_fine").alias("v"), F.col("_last").alias("t"))
    seen = sharded_scan(filled, [key], "_shard", ["window_no"], {"_prev": ("before", last)})
    here = F.struct("window_no", "n_readings", (_rounded(F.col("_sum"), F.col("n_readings")) / unit).alias("value"), F.lit(False).alias("is_missing"))
    wide = F.col("window_no") - F.col("_prev.w")
    between = lambda w: F.col("_prev.v") * (F.col("window_no") - w) + F.col("_fine") * (w - F.col("_prev.w"))
    missing = F.when(
        (F.col("_first") - F.col("_prev.t") <= round(session_gap_s * 1000)) & (wide > 1),
        F.transform(
            F.sequence(F.col("_prev.w") + 1, F.col("window_no") - 1),
            lambda w: F.struct(
                w.alias("window_no"),
                F.lit(0).cast("bigint").alias("n_readings"),
                (_rounded(between(w), wide * FINER) / unit).alias("value"),
                F.lit(True).alias("is_missing"),
            ),
        ),
    )
    rows = F.concat(F.array(here), F.coalesce(missing, F.array().cast("array<struct<window_no:bigint,n_readings:bigint,value:double,is_missing:boolean>>")))
    return seen.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def windows_touched(intervals: DataFrame, key: str, start: str, end: str, step_s: float = 10.0, longest_s: float = 3600.0) -> DataFrame:
    """Distinct ``(key, window_no)`` that an interval touches.

    Reversed bounds are swapped, a missing end counts as the start. An interval over
    ``longest_s`` is cut into stretches first, so no single row yields an unbounded array.
    """
    a, b = F.col(start).cast("double"), F.coalesce(F.col(end).cast("double"), F.col(start).cast("double"))
    step = round(step_s * 1000)
    per = max(1, int(longest_s / step_s))
    lo, hi = F.floor(F.round(F.least(a, b) * 1000) / step), F.floor(F.round(F.greatest(a, b) * 1000) / step)
    rows = intervals.where(F.col(key).isNotNull() & (F.abs(a) < 1e12) & (F.abs(b) < 1e12)).select(
        key, lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi")
    ).distinct()
    blocks = rows.select(key, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / per), F.floor(F.col("_hi") / per))).alias("_b"))
    return blocks.select(
        key, F.explode(F.sequence(F.greatest("_lo", F.col("_b") * per), F.least("_hi", F.col("_b") * per + per - 1))).alias("window_no")
    ).distinct()
