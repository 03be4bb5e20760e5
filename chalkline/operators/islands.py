"""Runs of rows in time order: gaps and islands, turns, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.alignment import SHARD_S, sharded
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise


def flag_islands(df: DataFrame, key: str, flag: Column, time: str = "time", order: tuple[str, ...] = ("time", "id"), values: tuple[Column, ...] = ()) -> DataFrame:
    """``(key, start, last, n, next_time, ...)``: maximal runs of rows where ``flag`` holds.

    ``next_time`` is the time of the row that ended the run, null for a run that lasts to the end of
    its recording. ``values`` are further aggregates over the run's rows. A recording is
    scanned in shards of an hour, so its length doesn't matter. ``order`` begins with ``time``.
    """
    rows = sharded(df, time).withColumn("_f", F.coalesce(flag, F.lit(False)))
    if not values:
        return _islands(rows, key, list(order), lambda a, b: a["f"] == b["f"])
    seen = sharded_scan(rows, [key], "_shard", list(order), {"_was": ("before", F.col("_f")), "_off": ("after", F.when(~F.col("_f"), F.col(time)))})
    inside = seen.where("_f").withColumn("_new", F.when(F.coalesce("_was", F.lit(False)), 0).otherwise(1))
    inside = materialise(inside)  # the next scan reads it twice
    counted = sharded_scan(inside, [key], "_shard", list(order), {"island": ("sum", F.col("_new"))})
    return counted.groupBy(key, "island").agg(
        F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n"), F.max("_off").alias("next_time"), *values
    ).drop("island")


def gap_islands(df: DataFrame, key: str, time: str, max_gap: float) -> DataFrame:
    """``(key, start, last, n)``: runs of times no more than ``max_gap`` apart."""
    rows = sharded(df, time).withColumn("_f", F.lit(True))
    return _islands(rows, key, [time], lambda a, b: F.round(b["t"] - a["t"], 6) <= max_gap).drop("next_time")


def _islands(rows: DataFrame, key: str, order: list[str], same: Callable[[Column, Column], Column]) -> DataFrame:
    """``(key, start, last, n, next_time)`` of the runs whose ``_f`` holds; ``same`` tells whether a row (t, f) and the one after it are of one run.

    Runs are found within shards, from their first and last rows alone. Only those that a shard begins or ends with, at most
    two a shard, are then put together over the recording.
    """
    w = Window.partitionBy(key, "_shard").orderBy(*order)
    me = F.struct(F.col(order[0]).alias("t"), F.col("_f").alias("f"))
    marked = rows.where(F.col(key).isNotNull() & F.col("_shard").isNotNull()).select(
        key, "_shard", *order, me.alias("_me"), F.lag(me).over(w).alias("_a"), F.lead(me).over(w).alias("_z"), F.row_number().over(w).alias("_i")
    )
    ends = lambda a, b: ~F.coalesce(same(F.col(a), F.col(b)), F.lit(False))
    edges = marked.withColumns({"_first": ends("_a", "_me"), "_last": ends("_me", "_z")}).where("_first or _last")
    end = F.struct("_me", "_i", "_z")
    local = edges.withColumn("_end", F.when(F.col("_last"), end).otherwise(F.lead(end).over(w))).where("_first").select(
        key, "_shard", "_i", F.col("_me.f").alias("_f"), F.col("_me.t").alias("start"), F.col("_end._me.t").alias("last"),
        (F.col("_end._i") - F.col("_i") + 1).cast("bigint").alias("n"), F.col("_end._z.t").alias("next_time"),
        F.col("_a").isNull().alias("_opens"), F.col("_end._z").isNull().alias("_closes"),
    )
    local = materialise(local.where("_f or _opens or _closes"))
    v = Window.partitionBy(key).orderBy("_shard", "_i")
    after = F.lead(F.struct("_f", "start")).over(v)
    before = F.lag(F.struct(F.col("last").alias("t"), F.col("_f").alias("f"))).over(v)
    own = F.struct(F.col("start").alias("t"), F.col("_f").alias("f"))
    outer = local.where("_opens or _closes").withColumns({"_b": before, "_c": after})
    outer = outer.withColumns({
        "_new": F.when(F.col("_opens") & F.coalesce(same(F.col("_b"), own), F.lit(False)), 0).otherwise(1),
        "next_time": F.when(F.col("_closes"), F.when(~F.col("_c._f"), F.col("_c.start"))).otherwise(F.col("next_time")),
    })
    whole = outer.withColumn("_k", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0))).where("_f").groupBy(key, "_k").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("next_time").alias("next_time")
    )
    return local.where("_f and not _opens and not _closes").select(key, "start", "last", "n", "next_time").unionByName(whole.drop("_k"))


def union_intervals(df: DataFrame, key: str, order: list[str], values: tuple[Column, ...], eps: float = 1e-6) -> DataFrame:
    """Intervals (key, start, end, ...) merged where they overlap or touch; ``values`` aggregate what is merged."""
    rows = df.withColumn("_shard", F.floor(F.col("start") / SHARD_S))
    seen = sharded_scan(rows, [key], "_shard", order, {"_reach": ("max_before", F.col("end"))})
    new = F.when(F.col("start") <= F.col("_reach") + eps, 0).otherwise(1)
    counted = sharded_scan(materialise(seen.withColumn("_new", new)), [key], "_shard", order, {"island": ("sum", F.col("_new"))})
    return counted.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *values)
