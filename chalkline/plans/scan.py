"""Ordered scans over entities larger than one task.

A running value over one entity (last seen, running maximum, running sum)
is computed in two levels: every (entity, shard) is scanned on its own, each
shard hands one summary row to a window over the entity's shards, and what
the earlier (or later) shards carry over is joined back. An entity thus costs
as many tasks as it has shards; the window over shards sees one row a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("before", "after", "max_before", "sum")


def sharded_scan(
    df: DataFrame,
    keys: Sequence[str],
    shard: str,
    order: Sequence[str],
    wanted: dict[str, tuple[str, Column]],
) -> DataFrame:
    """``df`` with a column for each entry of ``wanted``: name -> (kind, value).

    Kinds: ``before`` the last non-null value of an earlier row, ``after`` the
    first non-null value of a later row, ``max_before`` the largest value of the
    earlier rows, ``sum`` the sum up to and including this row. Shards must
    follow ``order``: all rows of a lower shard come before those of a higher.
    ``keys`` and ``shard`` may hold no nulls. Rows that tie in ``order`` come in
    no fixed order; give a unique order for a fixed result.
    """
    by = [*keys, shard]
    at = F.struct(*order)
    local = Window.partitionBy(*by).orderBy(*order)
    # what comes after is what comes before in reverse: a frame that only grows costs one pass
    reverse = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    over = {
        "before": local.rowsBetween(Window.unboundedPreceding, -1),
        "after": reverse.rowsBetween(Window.unboundedPreceding, -1),
        "max_before": local.rowsBetween(Window.unboundedPreceding, -1),
        "sum": local.rowsBetween(Window.unboundedPreceding, 0),
    }
    here = {
        "before": lambda v: F.last(v, ignorenulls=True),
        "after": lambda v: F.last(v, ignorenulls=True),
        "max_before": F.max,
        "sum": F.sum,
    }
    each = {
        "before": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
        "after": lambda v: F.min_by(v, F.when(v.isNotNull(), at)),
        "max_before": F.max,
        "sum": F.sum,
    }
    earlier = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(shard).desc()).rowsBetween(Window.unboundedPreceding, -1)

    scanned = df.withColumns({f"_{n}": here[kind](v).over(over[kind]) for n, (kind, v) in wanted.items()})
    summary = df.groupBy(*by).agg(*(each[kind](v).alias(f"_s_{n}") for n, (kind, v) in wanted.items()))
    carried = summary.select(
        *by,
        *(
            here[kind](F.col(f"_s_{n}")).over(later if kind == "after" else earlier).alias(f"_c_{n}")
            for n, (kind, _) in wanted.items()
        ),
    )
    both = scanned.join(carried, by)
    out = {}
    for n, (kind, _) in wanted.items():
        a, b = F.col(f"_{n}"), F.col(f"_c_{n}")
        if kind == "max_before":
            out[n] = F.greatest(a, b)
        elif kind == "sum":
            out[n] = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            out[n] = F.coalesce(a, b)
    return both.withColumns(out).drop(*(f"{p}{n}" for n in wanted for p in ("_", "_c_")))
