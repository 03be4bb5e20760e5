"""Filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.plans.session import materialise

RANK_SHARDS = 256


def _subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining sizes whose sum comes closest to the capacity, larger sizes first.

    Reachable sums are the bits of one integer; each size enters with the parts of a
    binary split of its count, and the choice is read back from the saved integers.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for size in sorted(counts, reverse=True):
        left, part = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(part, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(multiset of sizes, how many containers get it)`` until no item is left, by minimum bin slack.

    Every container is anchored by the largest size left, and the rest of its window is
    filled by the subset that leaves least slack; the same filling is repeated while its
    items last, so the plan's length depends on the number of sizes, not of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    plan = []
    while left:
        anchor = max(left)
        rest = dict(left)
        rest[anchor] -= 1
        if not rest[anchor]:
            del rest[anchor]
        chosen = _subset({s: n for s, n in rest.items() if s <= capacity - anchor}, capacity - anchor) if capacity > anchor else {}
        chosen[anchor] = chosen.get(anchor, 0) + 1
        times = min(left[s] // n for s, n in chosen.items())
        plan.append((chosen, times))
        for s, n in chosen.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Rows (size, first rank, items a container, first container): where the k-th item of a size goes."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for chosen, times in plan:
        for size, n in chosen.items():
            rows.append((size, used.get(size, 0), n, base))
            used[size] = used.get(size, 0) + n * times
        base += times
    return pd.DataFrame(rows, columns=["size", "rank", "each", "base"]).sort_values(["size", "rank"])


def fill_containers(items: DataFrame, record: list[str], size: str, capacity: int) -> DataFrame:
    """``items`` (``record``, ``size``) with the container each goes into; no container exceeds ``capacity``.

    Sizes are whole numbers from 0 to ``capacity``; items that are null, negative or
    larger have no container (null). Items of size 0 go into container 0. ``record`` must
    identify a row. Empty in, empty out.

    The sizes are counted first: at most ``capacity`` rows whatever the input, on which
    the plan is made. An item's container follows from its rank among the items of its
    size, found by a sharded count, so a size that a third of all items share isn't
    ranked in one task. The plan goes to the workers as an array of at most a few rows a size.
    """
    base = materialise(items.select(*record, F.col(size).cast("bigint").alias("_z")))
    fits = F.col("_z").between(1, capacity)
    shard = F.pmod(F.xxhash64(*record), F.lit(RANK_SHARDS))
    placed = base.where(fits).withColumn("_shard", shard)
    counted = placed.groupBy("_z", "_shard").agg(F.count("*").alias("n"))
    sizes = {int(r["_z"]): int(r["n"]) for r in counted.groupBy("_z").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_containers(sizes, capacity))
    key = slots["size"].to_numpy(np.int64) << 44 | slots["rank"].to_numpy(np.int64)
    lo, each, first = (slots[c].to_numpy(np.int64) for c in ("rank", "each", "base"))
    shared = base.sparkSession.sparkContext.broadcast((key, lo, each, first))

    @F.pandas_udf("long")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        key, lo, each, first = shared.value
        r = ranks.to_numpy(np.int64)
        at = np.searchsorted(key, sizes.to_numpy(np.int64) << 44 | r, "right") - 1
        return pd.Series(first[at] + (r - lo[at]) // each[at])

    before = Window.partitionBy("_z").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = counted.select("_z", "_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_z", "_shard").orderBy(*record)
    ranked = placed.withColumn("_k", F.row_number().over(local) - 1).join(offset, ["_z", "_shard"])
    done = ranked.select(*record, F.col("_z").alias(size), container("_z", F.col("_k") + F.col("_off")).alias("container"))
    none = F.when(F.col("_z") == 0, F.lit(0)).cast("bigint")
    rest = base.where(~F.coalesce(fits, F.lit(False))).select(*record, F.col("_z").alias(size), none.alias("container"))
    return done.unionByName(rest)
