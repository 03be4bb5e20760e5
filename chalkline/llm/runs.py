"""Runs of identical consecutive events collapsed into one event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.plans.session import materialise

#: Symbols of the event string: a break in time, and an event that belongs to the run before it.
BREAK, JOKER = "\u0001", "\u0002"
FIRST_SYMBOL = 0x4E00


def collapse_runs(
    events: DataFrame, key: str, time: str, code: str, max_step_s: float = 5.0, shard_s: float = 1024.0
) -> DataFrame:
    """``(key, first_s, last_s, n_points, duration_s, code)`` of each run.

    ``code`` is the canonical event as a number from 0 to 20,000, or null for an event
    that belongs to the run before it, whatever that is. Consecutive events with one
    code are a run; a step over ``max_step_s`` ends it. A null-coded event with no run
    before it starts one with a null code. Rows without key or time are ignored; events
    that tie in time are ordered by code, null last. Repeats count as events, so remove
    them first. Empty in, empty out.

    Codes become code points and each time shard of an entity one string; runs are the
    matches of a backreference pattern and their lengths give the spans, so an entity
    of any length costs strings of at most a shard. Runs at shard edges are stitched by
    a window over the edge runs alone, at most three a shard.
    """
    t = F.col(time).cast("double")
    symbol = F.coalesce(
        F.decode(F.unhex(F.lpad(F.hex(F.col(code).cast("bigint") + FIRST_SYMBOL), 4, "0")), "UTF-16BE"), F.lit(JOKER)
    )
    shards = (
        events.select(F.col(key), t.alias("_t"), symbol.alias("_s"), F.col(code).isNull().alias("_z"))
        .where(F.col(key).isNotNull() & (F.abs(F.col("_t")) < 1e12))
        .groupBy(key, F.floor(F.col("_t") / shard_s).alias("_shard"))
        .agg(F.sort_array(F.collect_list(F.struct("_t", "_z", "_s"))).alias("_e"))
    )
    step = round(max_step_s * 1000)
    broken = lambda i: F.round((F.col("_e")[i]["_t"] - F.col("_e")[i - 1]["_t"]) * 1000) > step
    text = F.array_join(
        F.transform(
            F.col("_e"), lambda e, i: F.concat(F.when((i > 0) & broken(F.greatest(i, F.lit(1))), BREAK).otherwise(""), e["_s"])
        ),
        "",
    )
    # a symbol, its repeats and the jokers between them; or jokers with nothing before
    pattern = f"([^{BREAK}{JOKER}])\\1*+(?:{JOKER}++\\1*+)*+|{JOKER}++"
    runs = (
        shards.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        # the run of each event, and from that the place where each run begins
        .withColumn("_r", F.flatten(F.transform("_m", lambda m, i: F.array_repeat(i, F.length(m)))))
        .withColumn("_n", F.concat(
            F.filter(F.sequence(F.lit(0), F.size("_r") - 1), lambda k: (k == 0) | (F.get("_r", k) != F.get("_r", F.greatest(k - 1, F.lit(0))))), F.array(F.size("_r"))
        ))
        .select(
            key, "_shard",
            F.explode(
                F.transform(
                    F.col("_m"),
                    lambda m, i: F.struct(
                        i.alias("no"), (F.size("_m") - 1 - i).alias("left"), F.substring(m, 1, 1).alias("s"),
                        F.col("_e")[F.col("_n")[i]]["_t"].alias("a"), F.col("_e")[F.col("_n")[i + 1] - 1]["_t"].alias("b"),
                        F.length(m).cast("bigint").alias("n"),
                    ),
                )
            ).alias("r"),
        )
        .select(key, "_shard", "r.*")
    )
    runs = materialise(runs)  # read twice below
    joker = F.col("s") == JOKER
    edge = (F.col("no") == 0) | (F.col("left") == 0) | (F.col("no") == 1)
    w = Window.partitionBy(key).orderBy("_shard", "no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    follows = (F.col("no") == F.lag("no").over(w) + 1) & (F.col("_shard") == F.lag("_shard").over(w)) | (
        (F.col("no") == 0) & (F.lag("left").over(w) == 0)
    )
    near = F.round((F.col("a") - F.lag("b").over(w)) * 1000) <= step
    chained = (
        runs.where(edge)
        .withColumn("_cut", F.when(follows & near, 0).otherwise(1))
        .withColumn("_chain", F.sum("_cut").over(upto))
    )
    c = Window.partitionBy(key, "_chain").orderBy("_shard", "no")
    stitched = (
        chained.withColumn("_known", F.last(F.when(~joker, F.col("s")), True).over(c.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_new", F.when(F.col("_known").eqNullSafe(F.lag("_known").over(c)) & (F.row_number().over(c) > 1), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(c.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_chain", "_run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.first("_known").alias("s"))
        .select(key, "a", "b", "n", "s")
    )
    inner = runs.where(~edge).select(key, "a", "b", "n", F.when(~joker, F.col("s")).alias("s"))
    back = F.conv(F.hex(F.encode("s", "UTF-16BE")), 16, 10).cast("int") - FIRST_SYMBOL
    return stitched.unionByName(inner).select(
        key, F.col("a").alias("first_s"), F.col("b").alias("last_s"), F.col("n").alias("n_points"),
        F.round(F.col("b") - F.col("a"), 3).alias("duration_s"), back.alias("code"),
    )
