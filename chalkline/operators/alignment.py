"""Aligning samples, slides, speech and topics on one time grid per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise_by

SHARD_S = 3600.0
#: Seconds of a recording whose spans meet its points in one row.
STRETCH = 300


def as_of(points: DataFrame, events: dict[str, tuple[DataFrame, str, list[str]]], key: str = "video_name", time: str = "time", both: bool = False) -> DataFrame:
    """``points`` with, for each named event set, the struct of its latest event at or before the point.

    ``events``: name -> (table, time column, columns kept). A point before every event gets
    the first one; a recording without events gets null. Of events at one time the one with the
    greater columns counts. With ``both``, the first event after the point comes too, as name_after.
    All sets go through one pass: a union in time order and a sharded scan, no range join.
    """
    cols = [c for c in points.columns if c not in (key, time)]
    none = {n: F.lit(None).cast(t.select(F.struct(*keep).alias("x")).schema["x"].dataType) for n, (t, _, keep) in events.items()}
    own = points.select(key, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_p"), *(none[n].alias(n) for n in events))
    p_type = own.schema["_p"].dataType
    rows = own
    for name, (t, at, keep) in events.items():
        rows = rows.unionByName(
            t.select(
                key, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(p_type).alias("_p"),
                *((F.struct(*keep) if n == name else none[n]).alias(n) for n in events),
            )
        )
    rows = rows.where(F.col(key).isNotNull() & F.col("_t").isNotNull()).withColumn("_shard", F.floor(F.col("_t") / SHARD_S))
    wanted = {}
    for n in events:
        wanted[f"{n}_b"] = ("before", F.col(n))
        wanted[f"{n}_a"] = ("after", F.col(n))
    seen = sharded_scan(rows, [key], "_shard", ["_t", "_side", *events], wanted).where("_side = 1")
    out = [F.coalesce(f"{n}_b", f"{n}_a").alias(n) for n in events]
    if both:
        out = [x for n in events for x in (F.col(f"{n}_b").alias(n), F.col(f"{n}_a").alias(f"{n}_after"))]
    return seen.select(key, F.col("_t").alias(time), "_p.*", *out)


def grid(lengths: DataFrame, key: str, length: str, resolution: float = 1.0) -> DataFrame:
    """Points 0, 1, ... ``int(length / resolution)`` of each recording: key, i, time."""
    n = F.floor(F.col(length) / resolution)
    per = 3600
    blocks = lengths.where(n >= 0).select(key, n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor(n / per))).alias("_b"))
    i = F.explode(F.sequence(F.col("_b") * per, F.least(F.col("_n"), F.col("_b") * per + per - 1))).alias("i")
    return blocks.select(key, i).withColumn("time", F.round(F.col("i") * resolution, 2))


def covered_points(intervals: DataFrame, key: str, start: str, end: str, resolution: float, payload: Column) -> DataFrame:
    """``(key, i, first)``: for each grid point in a closed interval the least payload covering it.

    An interval becomes the grid points it covers, in blocks of an hour, and these are
    reduced before they are joined, so the join is an equi-join with one row a point.
    """
    lo, hi = F.ceil(F.round(F.col(start) / resolution, 9)), F.floor(F.round(F.col(end) / resolution, 9))
    return _points(intervals.select(key, lo.alias("lo"), hi.alias("hi"), payload.alias("x")), key).groupBy(key, "i").agg(F.min("x").alias("first"))


def _points(spans: DataFrame, key: str, per: int = 3600) -> DataFrame:
    """``(key, i, x)``: the grid points from ``lo`` to ``hi``, both included, of spans (key, lo, hi, x)."""
    rows = spans.where("lo <= hi")
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / per), F.floor(F.col("hi") / per))))
    i = F.explode(F.sequence(F.greatest("lo", F.col("_b") * per), F.least("hi", F.col("_b") * per + per - 1))).alias("i")
    return blocks.select(key, i, "x")


def _neighbours(events: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """``events`` (key, ms unique in it, x) with the ms before and after; ``ends`` (key, ms) follow as events without x."""
    e = events.withColumn("_side", F.lit(0)).unionByName(ends.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    placed = e.withColumn("_shard", F.when(F.col("_side") == 1, F.lit(1 << 60)).otherwise(F.floor(F.col("ms") / (1000 * SHARD_S))))
    seen = sharded_scan(placed, [key], "_shard", ["_side", "ms"], {"prev": ("before", F.struct("ms")), "next": ("after", F.struct("_side", "ms"))})
    return seen.where("_side = 0 and next is not null")


def _ends(lengths: DataFrame, key: str, length: str, resolution: float) -> DataFrame:
    """The first point behind each recording's grid, in ms."""
    n = F.floor(F.round(F.col(length) / resolution, 9)).cast("bigint")
    return lengths.where(F.col(key).isNotNull() & (n >= 0)).select(key, ((n + 1) * round(resolution * 1000)).alias("ms"))


def _ms(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("bigint")


def latest_on_grid(events: DataFrame, key: str, time: str, order: str, payload: Column, lengths: DataFrame, length: str, resolution: float = 1.0) -> DataFrame:
    """``(key, i, x)``: at each grid point the latest event at or before it; before every event the first.

    Of events at one time the greatest by ``order`` is the latest, the least the first. An event
    holds from its time to the next one's, so only the events are put in order and each is then
    laid on the points it holds: the grid itself is neither sorted nor scanned. Times count in
    milliseconds; ``lengths`` (key, length) say where a recording's grid ends, one without has no points.
    """
    step = round(resolution * 1000)
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, _ms(time).alias("ms"), F.struct(F.col(order).alias("o"), payload.alias("v")).alias("x"))
    one = rows.groupBy(key, "ms").agg(F.struct(F.min("x").alias("first"), F.max("x").alias("last")).alias("x"))
    seen = _neighbours(one, _ends(lengths, key, length, resolution), key)
    lo, hi = F.greatest(F.ceil(F.col("ms") / step), F.lit(0)), F.ceil(F.col("next.ms") / step) - 1
    early = F.when(F.col("prev").isNull(), F.struct(F.lit(0).cast("bigint").alias("lo"), F.least(lo - 1, F.when(F.col("next._side") == 1, hi)).alias("hi"), F.col("x.first.v").alias("x")))
    held = F.struct(lo.alias("lo"), hi.alias("hi"), F.col("x.last.v").alias("x"))
    spans = seen.select(key, F.explode(F.filter(F.array(early, held), lambda s: s.isNotNull())).alias("s"))
    return _points(spans.select(key, "s.*"), key)


def enclosing_on_grid(intervals: DataFrame, key: str, payload: Column, lengths: DataFrame, length: str, resolution: float = 1.0) -> DataFrame:
    """``(key, i, x)``: for each grid point the payloads (in x.v) of the intervals (key, id, start, end) to choose from.

    The least x counts: the first interval in order of start and id that holds the point,
    else the one whose start is nearest, the earlier of two equally near. The nearest start is found
    by its cell, the points between the middles to its neighbours, so again only starts are put in order.
    """
    step = round(resolution * 1000)
    rows = intervals.where(F.col(key).isNotNull() & F.col("start").isNotNull())
    x = lambda rank: F.struct(F.lit(rank).alias("r"), F.col("start").alias("s"), F.col("id").alias("o"), payload.alias("v"))
    lo, hi = F.greatest(F.ceil(_ms("start") / step), F.lit(0)), F.floor(_ms("end") / step)
    inside = _points(rows.select(key, lo.alias("lo"), hi.alias("hi"), x(0).alias("x")), key)
    starts = rows.select(key, _ms("start").alias("ms"), x(1).alias("x")).groupBy(key, "ms").agg(F.min("x").alias("x"))
    seen = _neighbours(starts, _ends(lengths, key, length, resolution), key)
    after = F.when(F.col("next._side") == 1, F.col("next.ms") / step - 1).otherwise(F.floor((F.col("ms") + F.col("next.ms")) / (2 * step)))
    cell = seen.select(key, F.coalesce(F.floor((F.col("prev.ms") + F.col("ms")) / (2 * step)) + 1, F.lit(0)).alias("lo"), after.cast("bigint").alias("hi"), "x")
    return inside.unionByName(_points(cell.withColumn("lo", F.greatest("lo", F.lit(0))), key))


def on_grid(lengths: DataFrame, key: str, length: str, columns: dict[str, DataFrame], resolution: float = 1.0) -> DataFrame:
    """Grid points ``(key, i)`` with a column for each of ``columns``: name -> (key, i, x), the least x of the point or null.

    Recordings without a key or length have no points. One shuffle and one sort by point bring everything together; rows outside a recording's grid are dropped.
    """
    rows = grid(lengths.where(F.col(key).isNotNull()), key, length, resolution).select(key, "i", F.lit(True).alias("_own"))
    for n, t in columns.items():
        rows = rows.unionByName(t.select(key, "i", F.col("x").alias(n)), allowMissingColumns=True)
    # partitioned first: no sorting for a partial step that has nothing to reduce
    return rows.repartition(key, "i").groupBy(key, "i").agg(F.max("_own").alias("_own"), *(F.min(n).alias(n) for n in columns)).where("_own").drop("_own")


def near_points(events: DataFrame, key: str, time: str, resolution: float, within: float, inclusive: bool = False) -> DataFrame:
    """Distinct grid points ``(key, i)`` less (or no more) than ``within`` seconds from an event."""
    t = F.col(time)
    lo, hi = F.ceil((t - within) / resolution), F.floor((t + within) / resolution)
    d = F.round(F.abs(F.col("i") * resolution - F.col("_t")), 6)
    rows = events.select(key, t.alias("_t"), F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0)))).alias("i"))
    return rows.where(d <= within if inclusive else d < within).select(key, "i").distinct()


def contained(inner: DataFrame, outer: DataFrame, key: str, bucket: int = 300) -> DataFrame:
    """``(key, id, outer_id)``: every pair where interval ``inner`` (key, id, start, end) lies wholly in ``outer``.

    The outer interval goes to each time bucket it touches, the inner one to that of its start
    alone, so a pair meets once and a long recording is spread over its buckets.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    o = outer.where("start <= end").select(key, F.col("id").alias("outer_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(b("start"), b("end"))).alias("_b"))
    return inner.select(key, "id", "start", "end", b("start").alias("_b")).join(o, [key, "_b"]).where("start >= _s and end <= _e").select(key, "id", "outer_id")


def sharded(df: DataFrame, time: str = "time") -> DataFrame:
    """``df`` with its ``_shard`` by time; as it is where it has one."""
    return df if "_shard" in df.columns else df.withColumn("_shard", F.floor(F.col(time) / SHARD_S))


def ordered(df: DataFrame, key: str, order: Sequence[str] = ("time", "id")) -> DataFrame:
    """``df`` with ``_shard``, written once by recording and shard: scans and windows by these read it without another shuffle."""
    return materialise_by(sharded(df, order[0]).where(F.col(key).isNotNull() & F.col("_shard").isNotNull()), [key, "_shard"], order)


def with_spans(points: DataFrame, spans: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """``points`` with an array of (a, b) for each of ``kinds``: the spans (key, _kind, a, b) of this kind that touch the point's STRETCH.

    Spans are listed for each STRETCH that they touch and looked up there, so points are neither put in order nor multiplied; nor are
    they moved where they are spread by shard already.
    """
    part = lambda c: F.floor(F.col(c) / STRETCH)
    listed = [F.collect_list(F.when(F.col("_kind") == k, F.struct("a", "b"))).alias(f"_{k}") for k in kinds]
    here = spans.select(key, F.explode(F.sequence(part("a"), part("b"))).alias("_part"), "_kind", "a", "b").groupBy(key, "_part").agg(*listed)
    rows = points.withColumn("_part", part("time"))
    if "_shard" not in points.columns:
        return rows.join(here.hint("shuffle_hash"), [key, "_part"], "left").drop("_part")
    each = F.struct("_part", F.struct(*(f"_{k}" for k in kinds)))
    hours = here.groupBy(key, F.floor(F.col("_part") * STRETCH / SHARD_S).alias("_shard")).agg(F.map_from_entries(F.collect_list(each)).alias("_here"))
    got = rows.join(hours.hint("shuffle_hash"), [key, "_shard"], "left").withColumn("_here", F.col("_here")[F.col("_part")])
    return got.select(*points.columns, "_here.*")


def numbered(df: DataFrame, key: str, order: list[str], time: str = "time") -> DataFrame:
    """``df`` with its row number ``idx`` from 0 within the recording, without sorting a recording in one task."""
    placed = df.withColumn("_shard", F.floor(F.col(time) / SHARD_S))
    return sharded_scan(placed, [key], "_shard", order, {"idx": ("sum", F.lit(1))}).withColumn("idx", F.col("idx") - 1).drop("_shard")


def with_halo(df: DataFrame, key: str, before: int, after: int, size: int = 2000) -> tuple[DataFrame, object, Column]:
    """Rows numbered by ``idx`` in blocks, each with the rows around it that a row window needs.

    Returns the rows, the window specification to compute over, and the filter that keeps
    each row once afterwards.
    """
    lo, hi = F.greatest(F.floor((F.col("idx") - after) / size), F.lit(0)), F.floor((F.col("idx") + before) / size)
    rows = df.withColumn("_block", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(key, "_block").orderBy("idx")
    return rows, w, F.col("_block") == F.floor(F.col("idx") / size)
