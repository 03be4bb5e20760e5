"""Pairing records with the record nearest in time of the same entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.plans.session import materialise


def _settled(t: pa.Table, tolerance: int, final: bool) -> tuple[pa.Table, pa.Table]:
    """Left rows of sorted rows with the right records around them, where these are known; and the rows still needed.

    A left row waits for a later right record of its entity as long as one may come within the tolerance; what is
    kept is those that wait and the right record before them.
    """
    n = t.num_rows
    code = t["k"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ms = t["ms"].to_numpy()
    right = t["side"].to_numpy() == 0
    at = np.arange(n)
    back = np.maximum.accumulate(np.where(right, at, -1))
    ahead = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    rows = np.flatnonzero(~right)
    a_ok = (ahead[rows] < n) & (code[np.minimum(ahead[rows], n - 1)] == code[rows])
    waits = ~a_ok & (code[rows] == code[-1]) & (ms[-1] - ms[rows] <= tolerance) & (not final)
    keep = rows[waits]
    if not final and back[-1] >= 0 and code[back[-1]] == code[-1]:
        keep = np.concatenate([[back[-1]], keep])
    rows, a_ok = rows[~waits], a_ok[~waits]
    b, a = back[rows], ahead[rows]
    b_ok = (b >= 0) & (code[np.maximum(b, 0)] == code[rows])
    r = t["r"].combine_chunks()

    def near(found: np.ndarray, ok: np.ndarray) -> tuple[pa.Array, pa.Array]:
        index = pa.array(np.where(ok, found, 0), mask=~ok)
        return pa.array(ms[np.where(ok, found, 0)], mask=~ok), r.take(index)

    b_ms, b_r = near(b, b_ok)
    a_ms, a_r = near(a, a_ok)
    left = t.take(pa.array(rows))
    out = pa.table(
        {
            "pid": left["pid"], "k": left["k"], "ms": left["ms"], "l": left["l"],
            "b_ms": b_ms, "b_r": b_r, "a_ms": a_ms, "a_r": a_r,
        }
    )
    return out, t.take(pa.array(keep))


def _scan(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The right records before and after each left row of one sorted partition, batch by batch: its size doesn't matter."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if t.num_rows:
                done, held = _settled(t, tolerance, False)
                yield from done.to_batches()
        if held is not None and held.num_rows:
            yield from _settled(held.combine_chunks(), tolerance, True)[0].to_batches()

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    keep_left: Sequence[str],
    keep_right: Sequence[str],
    tolerance_s: float,
    partitions: int | None = None,
) -> DataFrame:
    """Each left row with the right row of the same ``key`` nearest in time.

    Columns: key, struct ``l`` of ``keep_left``, struct ``r`` of ``keep_right`` (null
    where nothing lies within ``tolerance_s``, bounds included), ``distance_ms``. Times
    are compared in whole milliseconds. Of two right rows equally far the earlier
    counts; of several at one time the one whose kept columns compare least. Left
    rows repeat as often as they come; those without key or (finite) time have no
    partner but are kept. Right rows without key or time are ignored. Names may
    clash between the sides, they live in separate structs. Empty tables are fine.

    Both sides are range-partitioned together by entity and time, so a large entity
    spans many tasks and a task's size doesn't depend on the entities. Each partition
    is scanned once; the partner of a row near a partition's edge may lie in another
    partition, so the first and last right record of each (partition, entity) go
    through a prefix scan over the entity's partitions and come back as carries.
    """
    spark = left.sparkSession
    ms = lambda c: F.when(F.abs(F.col(c).cast("double")) < 1e12, F.round(F.col(c).cast("double") * 1000).cast("bigint"))
    rows = left.select(F.col(key).alias("k"), ms(left_time).alias("ms"), F.struct(*keep_left).alias("l"))
    rights = (
        right.select(F.col(key).alias("k"), ms(right_time).alias("ms"), F.struct(*keep_right).alias("r"))
        .where("k is not null and ms is not null")
        .groupBy("k", "ms")
        .agg(F.min("r").alias("r"))
    )
    l_type, r_type = rows.schema["l"].dataType, rights.schema["r"].dataType
    both = rights.select("k", "ms", F.lit(0).alias("side"), F.lit(None).cast(l_type).alias("l"), "r").unionByName(
        rows.where("k is not null and ms is not null").select(
            "k", "ms", F.lit(1).alias("side"), "l", F.lit(None).cast(r_type).alias("r")
        )
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tol = round(tolerance_s * 1000)
    ranged = materialise(
        both.repartitionByRange(n, "k", "ms", "side", "l")
        .sortWithinPartitions("k", "ms", "side", "l")
        .withColumn("pid", F.spark_partition_id())
    )
    k_type = ranged.schema["k"].dataType
    schema = (
        T.StructType()
        .add("pid", T.IntegerType()).add("k", k_type).add("ms", T.LongType()).add("l", l_type)
        .add("b_ms", T.LongType()).add("b_r", r_type).add("a_ms", T.LongType()).add("a_r", r_type)
    )
    scanned = materialise(ranged.mapInArrow(_scan(tol), schema))

    rec = F.when(F.col("side") == 0, F.struct("ms", "r"))
    w = Window.partitionBy("k").orderBy("pid")
    reverse = Window.partitionBy("k").orderBy(F.desc("pid"))
    carry = (
        ranged.groupBy("k", "pid")
        .agg(F.max(rec).alias("last"), F.min(rec).alias("first"))
        .select(
            "k", "pid",
            F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.last("first", True).over(reverse.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
        )
        .where("before is not null or after is not null")
    )
    b = F.when(F.col("b_ms").isNotNull(), F.struct((F.col("ms") - F.col("b_ms")).alias("d"), F.lit(0).alias("s"), F.col("b_r").alias("r")))
    a = F.when(F.col("a_ms").isNotNull(), F.struct((F.col("a_ms") - F.col("ms")).alias("d"), F.lit(1).alias("s"), F.col("a_r").alias("r")))
    c = F.when(F.col("before").isNotNull(), F.struct((F.col("ms") - F.col("before.ms")).alias("d"), F.lit(0).alias("s"), F.col("before.r").alias("r")))
    d = F.when(F.col("after").isNotNull(), F.struct((F.col("after.ms") - F.col("ms")).alias("d"), F.lit(1).alias("s"), F.col("after.r").alias("r")))
    best = F.least(F.coalesce(b, c), F.coalesce(a, d))
    hit = F.col("_best.d") <= tol
    # only the rows before the first or after the last right record of their partition need a carry
    alone = F.col("b_ms").isNull() | F.col("a_ms").isNull()
    none = F.lit(None).cast(carry.schema["before"].dataType)
    both_sides = scanned.where(~alone).withColumns({"before": none, "after": none})
    edge = scanned.where(alone).join(carry, ["k", "pid"], "left")
    found = both_sides.unionByName(edge).withColumn("_best", best).select(
        F.col("k").alias(key), "l", F.when(hit, F.col("_best.r")).alias("r"), F.when(hit, F.col("_best.d")).alias("distance_ms")
    )
    lost = rows.where("k is null or ms is null").select(
        F.col("k").alias(key), "l", F.lit(None).cast(r_type).alias("r"), F.lit(None).cast("bigint").alias("distance_ms")
    )
    return found.unionByName(lost)
