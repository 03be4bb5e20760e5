"""Folds over candidate boundaries: each decision depends on the one before.

A decision can only reach as far as its threshold, so an hour of a recording depends on what came before only by
the last boundary kept, one of the few near its start. Every hour is folded for each of these, the outcomes are chained
over a recording's hours, and each hour is then folded from its true start: no recording is one array or task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chalkline.functions import config as C
from chalkline.operators.alignment import SHARD_S
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise


def _walk(rows: list[tuple], last: tuple | None, reach: float, strict: bool, replace: bool) -> tuple[list[tuple], tuple | None, bool]:
    """Candidates (time, rank, score) kept after ``last``, what is kept last, and whether ``last`` itself was replaced."""
    kept: list[tuple] = []
    replaced = False
    for x in rows:
        d = None if last is None else x[0] - last[0]
        if d is None or (d > reach if strict else d >= reach):
            kept.append(x)
        elif replace and x[2] > last[2]:
            replaced = replaced or not kept
            kept = [*kept[:-1], x] if kept else [x]
        else:
            continue
        last = x
    return kept, last, replaced


def thinned(candidates: DataFrame, key: str, reach: float, strict: bool = False, replace: bool = True) -> DataFrame:
    """``(key, time, rank, score)``: in order of time and rank, a candidate at least ``reach`` after the last kept is kept.

    More than ``reach`` with ``strict``. A nearer one replaces the last kept if its score is higher, where ``replace``;
    else it goes. A task gets the candidates of an hour and those within ``reach`` before it. Rows should be
    unique in time and rank; those without key or time are left out.
    """
    if reach >= SHARD_S:
        raise ValueError(f"a reach of {reach} s is longer than a shard")
    rows = candidates.select(key, F.col("time").cast("double").alias("time"), F.col("rank").cast("int").alias("rank"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.where(F.col(key).isNotNull() & F.col("time").isNotNull()).withColumn("shard", F.floor(F.col("time") / SHARD_S))
    near = F.col("time") >= (F.col("shard") + 1) * SHARD_S - reach - 1
    where = F.explode(F.when(near, F.array(F.struct("shard", F.lit(True).alias("own")), F.struct((F.col("shard") + 1).alias("shard"), F.lit(False).alias("own")))).otherwise(F.array(F.struct("shard", F.lit(True).alias("own")))))
    spread = materialise(rows.select(key, "time", "rank", "score", where.alias("w")).select(key, "time", "rank", "score", "w.*"))
    kind = dict(candidates.dtypes)[key]

    def parts(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        return [x[2:5] for x in rows if x[5]], [x[2:5] for x in rows if not x[5]]

    def outcomes(group: tuple, rows: list[tuple]) -> list[tuple]:
        own, before = parts(rows)
        out = []
        for start in (None, *before):
            _, last, replaced = _walk(own, start, reach, strict, replace)
            # what is kept last, if it is of this hour; else nothing that matters to the next
            end = last if own and last is not None and last != start else None
            out.append((*group, *(start or (None, None))[:2], *(end or (None, None))[:2], replaced))
        return out

    def chain(group: tuple, rows: list[tuple]) -> list[tuple]:
        """For each hour what was kept last before it, and whether the hour after replaces what is kept last in it."""
        table: dict = {}
        for _, k, t, r, tt, tr, x in rows:
            table.setdefault(k, {})[None if t is None else (t, r)] = (None if tt is None else (tt, tr), x)
        at, out, last = None, [], None
        for k in sorted(table):
            at = at if last == k - 1 and at in table[k] else None
            if at is not None and table[k][at][1]:
                out[-1][-1] = True
            out.append([*group, k, *(at or (None, None)), False])
            at, last = table[k][at][0], k
        return [tuple(x) for x in out]

    def kept(group: tuple, rows: list[tuple]) -> list[tuple]:
        own, before = parts(rows)
        t, r, loses = rows[0][6:]
        start = None if t is None else next(x for x in before if x[:2] == (t, r))
        found = _walk(own, start, reach, strict, replace)[0]
        return [(group[0], *x) for x in (found[:-1] if loses else found)]

    columns = [key, "shard", "time", "rank", "score", "own"]
    states = _each_group(spread.select(*columns), [key, "shard"], ["time", "rank"], outcomes, f"{key} {kind}, shard long, time double, rank int, to_time double, to_rank int, replaced boolean")
    starts = _each_group(states, [key], ["shard"], chain, f"{key} {kind}, shard long, from_time double, from_rank int, loses boolean")
    given = spread.join(starts, [key, "shard"]).select(*columns, "from_time", "from_rank", "loses")
    return _each_group(given, [key, "shard"], ["time", "rank"], kept, f"{key} {kind}, time double, rank int, score double")


def _each_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``work`` makes of each group's key and rows in order, as rows of ``schema``; ``keys`` are the first columns.

    One pass over sorted partitions: many small groups cost no more than their rows. Partitions are by a hash of the keys, since
    a repartition by the keys themselves is taken for needless after a join by them, whose shuffle may then be read in parts of a group.
    """
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for group, mine in itertools.groupby(rows, lambda r: r[: len(keys)]):
            out += work(group, list(mine))
            if len(out) >= 10_000:
                yield _batch(out, fields)
                out = []
        yield _batch(out, fields)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def merge_candidates(candidates: DataFrame, key: str, within: float = C.CONFIG.merge_within) -> DataFrame:
    """Candidates (key, time, rank, score): one more than ``within`` from the last kept is kept, a nearer one replaces it if its score is higher."""
    return thinned(candidates, key, within, strict=True)


def normalize_boundaries(bounds: DataFrame, ends: DataFrame, key: str, shortest: float = C.CONFIG.min_knowledge, longest: float = C.CONFIG.max_knowledge, eps: float = C.CONFIG.eps) -> DataFrame:
    """``(key, pos, time)``: bounds (key, time) at least ``shortest`` apart, wider gaps divided evenly.

    ``ends`` has (key, t_start, t_end). The first bound is t_start; bounds before it are
    skipped; t_end comes last unless it is there already. Times are rounded to hundredths after every step.
    """
    ends = materialise(ends)
    inside = bounds.join(ends, key).where(F.col("time") > F.col("t_start") + eps).select(key, "time").distinct()
    all_bounds = inside.unionByName(ends.select(key, F.round("t_start", 2).alias("time"))).distinct()
    bounds = all_bounds.withColumns({"rank": F.lit(0), "score": F.lit(0.0)})
    kept = thinned(bounds, key, shortest, replace=False).select(key, "time").withColumn("_shard", F.floor(F.col("time") / SHARD_S))
    kept = materialise(kept)
    seen = sharded_scan(kept, [key], "_shard", ["time"], {"prev": ("before", F.round("time", 2))})
    dt = F.col("time") - F.col("prev")
    n = F.floor(dt / longest)
    even = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))), F.array("prev"),
        lambda acc, _: F.concat(acc, F.array(F.round(F.element_at(acc, -1) + dt / (n + 1), 2))),
    )
    more = F.when(dt > longest, F.slice(even, 2, n.cast("int"))).otherwise(F.array().cast("array<double>"))
    points = seen.select(key, F.explode(F.concat(F.coalesce(more, F.array().cast("array<double>")), F.array(F.round("time", 2)))).alias("time"))
    points = materialise(points)
    last = points.groupBy(key).agg(F.max("time").alias("_last"))
    closing = ends.join(last, key).where(F.abs(F.col("_last") - F.round("t_end", 2)) >= eps).select(key, F.round("t_end", 2).alias("time"), F.lit(1).alias("_end"))
    rows = points.withColumn("_end", F.lit(0)).unionByName(closing).withColumn("_shard", F.when(F.col("_end") == 1, 1e12).otherwise(F.floor(F.col("time") / SHARD_S)))
    return sharded_scan(rows, [key], "_shard", ["_end", "time"], {"pos": ("sum", F.lit(1))}).select(key, F.col("pos").cast("bigint").alias("pos"), "time")


def post_process(times: DataFrame, points: DataFrame, key: str, min_gap: float = C.CONFIG.post_min_gap, max_gap: float = C.CONFIG.post_max_gap) -> DataFrame:
    """``(key, time)``: predicted times thinned to ``min_gap``, and gaps over ``max_gap`` split at their best point.

    ``times`` has (key, time, score), ``points`` (key, time, score). Nearer than ``min_gap`` the higher
    score stays. A wide gap is split at its highest-scoring point, the first of equals, or ``min_gap``
    after its start where that point is nearer, until the rest is short. A task gets the points of one wide gap.
    """
    kept = thinned(times.withColumn("rank", F.lit(0)), key, min_gap).select(key, "time")
    kept = materialise(kept)
    placed = kept.withColumn("_shard", F.floor(F.col("time") / SHARD_S))
    seen = sharded_scan(placed, [key], "_shard", ["time"], {"prev": ("before", F.col("time"))})
    wide = seen.where(F.col("time") - F.col("prev") > max_gap).select(key, "prev", F.col("time").alias("until"))
    blocks = wide.withColumn("_b", F.explode(F.sequence(F.floor(F.col("prev") / SHARD_S), F.floor(F.col("until") / SHARD_S))))
    inside = blocks.join(points.withColumn("_b", F.floor(F.col("time") / SHARD_S)), [key, "_b"]).where("time between prev and until")
    given = wide.join(inside.select(key, "prev", "time", "score"), [key, "prev"], "left")
    key_type = dict(times.dtypes)[key]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        t, s, end = pdf["time"].to_numpy(), pdf["score"].to_numpy(), float(pdf["until"].iloc[0])
        at, out = float(pdf["prev"].iloc[0]), []
        while end - at > max_gap:
            ok = t >= at
            cut = round(float(t[ok][s[ok].argmax()]), 2) if ok.any() else round((at + end) / 2, 2)
            if cut - at < min_gap:
                cut = round(at + min_gap, 2)
            if end - cut < min_gap:
                break
            out.append(cut)
            at = cut
        return pd.DataFrame({key: pdf[key].iloc[0], "time": pd.Series(out, dtype=float)})

    more = given.groupBy(key, "prev").applyInPandas(split, f"{key} {key_type}, time double")
    return kept.unionByName(more).select(key, F.round("time", 2).alias("time")).distinct()
