"""Continuous periods and gaps of time intervals, per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.plans.scan import sharded_scan

SHARD_MS = 3_600_000
SESSION_GAP_MS = 1_800_000
#: Seconds outside this range (over 30,000 years) are no times.
MAX_S = 1e12


def _ms(name: str):
    x = F.col(name).cast("double")
    return F.when(F.abs(x) <= MAX_S, F.round(x * 1000).cast("bigint"))


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", shard_ms: int = SHARD_MS
) -> DataFrame:
    """Disjoint periods ``(keys, from_ms, to_ms)`` covering the same time as the intervals.

    Intervals that overlap, nest or touch become one period. Reversed bounds are
    swapped; rows with a null key, a missing, NaN or infinite bound, or no length
    are ignored; an empty table gives an empty result. Other columns, whatever
    their names, are not read.

    Two levels: an interval is clipped to its first and last time shard; the whole
    shards between are one span row, so a long interval costs three rows, not one a
    shard. Shards are merged on their own. Only coverage that touches a shard
    boundary is then stitched over the entity, at most three rows a shard.
    """
    a, b = _ms(start), _ms(end)
    rows = (
        df.select(*keys, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), a.alias("_x"), b.alias("_y"))
        .where("_x is not null and _y is not null and _a < _b")
        .dropna(subset=list(keys))
        .select(
            *keys, "_a", "_b",
            F.floor(F.col("_a") / shard_ms).cast("bigint").alias("_i"),
            F.floor((F.col("_b") - 1) / shard_ms).cast("bigint").alias("_j"),
        )
    )
    shard = lambda k, s, e: F.struct(k.alias("shard"), s.alias("s"), e.alias("e"), F.lit(False).alias("span"))
    i, j = F.col("_i"), F.col("_j")
    pieces = F.array(
        shard(i, F.col("_a"), F.least(F.col("_b"), (i + 1) * shard_ms)),
        F.when(j > i, shard(j, j * shard_ms, F.col("_b"))),
        F.when(
            j > i + 1,
            F.struct(
                (i + 1).alias("shard"), ((i + 1) * shard_ms).alias("s"), (j * shard_ms).alias("e"),
                F.lit(True).alias("span"),
            ),
        ),
    )
    clipped = rows.select(*keys, F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select(*keys, "p.*")
    # one row per start: repeats and hot starts meet before the sort
    clipped = clipped.groupBy(*keys, "shard", "span", "s").agg(F.max("e").alias("e"))

    by = [*keys, "shard"]
    w = Window.partitionBy(*by).orderBy("s")
    spans = clipped.where("span")
    local = (
        clipped.where("not span")
        .withColumn("_reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0))
        .withColumn("_n", F.sum("_new").over(w))
        .groupBy(*by, "_n")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    lo, hi = F.col("shard") * shard_ms, (F.col("shard") + 1) * shard_ms
    local = local.withColumn("_edge", (F.col("s") == lo) | (F.col("e") == hi))

    # which shards lie wholly under a span that began at or before them
    state = (
        local.select(*by, F.lit(None).cast("bigint").alias("to"))
        .unionByName(spans.select(*by, F.floor(F.col("e") / shard_ms).cast("bigint").alias("to")))
        .groupBy(*by)
        .agg(F.max("to").alias("to"))
    )
    w_shards = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    covered = state.withColumn("_under", F.coalesce(F.max("to").over(w_shards) > F.col("shard"), F.lit(False)))
    local = local.join(covered.where("_under").select(*by, "_under"), by, "left").where("_under is null")

    edges = local.where("_edge").select(*keys, "s", "e").unionByName(spans.select(*keys, "s", "e"))
    v = Window.partitionBy(*keys).orderBy("s", "e")
    stitched = (
        edges.withColumn("_reach", F.max("e").over(v.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0))
        .withColumn("_n", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_n")
        .agg(F.min("s").alias("from_ms"), F.max("e").alias("to_ms"))
        .drop("_n")
    )
    inner = local.where("not _edge").select(*keys, F.col("s").alias("from_ms"), F.col("e").alias("to_ms"))
    return stitched.unionByName(inner)


def periods_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    session_gap_ms: int = SESSION_GAP_MS,
    shard_ms: int = SHARD_MS,
) -> DataFrame:
    """``(keys, kind, from_ms, to_ms)``: each period, and each gap inside a session.

    A pause longer than ``session_gap_ms`` ends the session and is no gap. Null,
    empty and repeated input is treated as in :func:`merge_intervals`.
    """
    periods = merge_intervals(df, keys, start, end, shard_ms)
    placed = periods.withColumn("_shard", F.floor(F.col("from_ms") / shard_ms))
    seen = sharded_scan(placed, keys, "_shard", ["from_ms"], {"_prev": ("before", F.col("to_ms"))})
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_ms").alias("f"), F.col("to_ms").alias("t")),
        F.when(
            F.col("from_ms") - F.col("_prev") <= session_gap_ms,
            F.struct(F.lit("gap").alias("kind"), F.col("_prev").alias("f"), F.col("from_ms").alias("t")),
        ),
    )
    return seen.select(*keys, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_x")).select(
        *keys, F.col("_x.kind").alias("kind"), F.col("_x.f").alias("from_ms"), F.col("_x.t").alias("to_ms")
    )
