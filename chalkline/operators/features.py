"""Features and labels of timeline points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chalkline.functions import text as X
from chalkline.functions.config import CONFIG
from chalkline.operators.alignment import numbered, with_halo

ROWS = 10
FEATURES = (
    "present", "motion", "slide", "confidence", "silent", "prev_present", "prev_confidence", "slide_delta", "roll_silence",
    "roll_present", "text_similarity", "rate_change", "speaker_change", "roll_silence_ahead",
)


def point_features(timeline: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(video_name, id, time, 14 features)`` of each timeline point.

    Windows are rows: the point and the ROWS before (or after) it. A recording's first point
    has itself as its predecessor. Points are numbered by a sharded scan and windowed in blocks
    with a halo, so all fourteen share one sort and no recording is one task. Those that have a ``_shard``, which is kept, are
    windowed where they are, but for the ROWS at either end of a shard.
    """
    # word sets only where the text is not that of the point before, which it mostly is
    text = F.concat("speech_text", F.lit(" "), "ppt_text")
    placed = [c for c in timeline.columns if c == "_shard"]
    slim = timeline.select(
        "video_name", "id", "time", "present", "motion", "slide", "confidence", "silent", "slide_idx", "speaker",
        text.alias("_text"), F.length("speech_text").alias("_length"), *placed,
    )
    if placed:
        within = Window.partitionBy("video_name", "_shard").orderBy("time", "id")
        near = lambda n: F.lag(F.lit(1), n).over(within).isNull() | F.lead(F.lit(1), n).over(within).isNull()
        # what an end's rows look at are the next ROWS inside and, beyond, only rows of other shards' ends
        at_ends = slim.withColumns({"_end": near(ROWS), "_seen": near(2 * ROWS)}).where("_seen").drop("_seen")
        inner = _windowed(slim.withColumn("_end", near(ROWS)), within).where("not _end")
        out = inner.unionByName(_windowed(at_ends, Window.partitionBy("video_name").orderBy("time", "id")).where("_end")).drop("_end")
    else:
        rows, w, once = with_halo(numbered(slim, "video_name", ["time", "id"]), "video_name", ROWS, ROWS)
        out = _windowed(rows, w).where(once)
    num = lambda c: F.col(c).cast("int")
    changed = F.col("_text") != F.col("_prev_text")
    out = out.withColumns({"_words": F.when(changed, X.word_set(F.col("_text"))), "_prev_words": F.when(changed, X.word_set(F.col("_prev_text")))})
    out = out.withColumns({
        "text_similarity": F.when(F.col("_words").isNull(), 1.0).otherwise(X.jaccard(F.col("_words"), F.col("_prev_words"))),
        "rate_change": F.abs(F.col("_length") - F.col("_prev_length")) / max(resolution, 1e-3),
        "present": num("present"), "slide": num("slide"), "silent": num("silent"),
    })
    return out.select("video_name", "id", "time", *FEATURES, *placed)


def _windowed(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """``rows`` with what their features take from the rows around."""
    back, ahead = w.rowsBetween(-ROWS, 0), w.rowsBetween(0, ROWS)
    num = lambda c: F.col(c).cast("int")
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    return rows.withColumns({
        "prev_present": prev("present").cast("int"), "prev_confidence": prev("confidence"),
        "slide_delta": (F.col("slide_idx") != prev("slide_idx")).cast("int"),
        "roll_silence": F.avg(num("silent")).over(back), "roll_present": F.avg(num("present")).over(back),
        "roll_silence_ahead": F.avg(num("silent")).over(ahead),
        "_prev_text": prev("_text"), "_prev_length": prev("_length"), "speaker_change": (F.col("speaker") != prev("speaker")).cast("int"),
    })


def class_weights(rows: DataFrame, label: str, positive: float = CONFIG.positive_weight) -> DataFrame:
    """``(label, n, weight)``: balanced weights, the positive class's multiplied."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = F.col("total") / (F.col("k") * F.col("n")) * F.when(F.col(label) == 1, positive).otherwise(1.0)
    return n.join(F.broadcast(total), how="cross").select(label, "n", w.alias("weight"))  # one row


def draw(*key: str, buckets: int = 1_000_003):
    """A fixed pseudo-random number below ``buckets`` for whole-number keys: the same on every engine."""
    x = F.lit(17).cast("bigint")
    for k in key:
        x = (x * 31 + F.pmod(F.col(k).cast("bigint"), F.lit(buckets)) * 7919 + 104729) % buckets
    return x


def drawn(rows: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` from 1 in each group, in an order drawn by the fixed numbers of their ``key`` (whole number last).

    Ranks are counted in two levels: within a number, and over the numbers' counts, of which a group has at most
    1,000,003. Rows of one number go by key, so the key should tell rows apart; ranks of equal rows come in no fixed order.
    """
    numbered = rows.withColumn("_d", draw(key[-1]))
    counts = numbered.groupBy(*group, "_d").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*group, "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_d").orderBy(*key)
    both = numbered.withColumn("_k", F.row_number().over(inside)).alias("a").join(offset.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_d")])
    return both.select("a.*", (F.col("_k") + F.col("_before")).alias("_rank")).drop("_d", "_k")


def first_drawn(rows: DataFrame, label: str, wanted: dict[int, int], key: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: whether a row is among the first so many of its ``label``, in the order of :func:`drawn`.

    Rows are counted by label and fixed number; only those of the one number in which a count is reached are
    put in order. Rows of labels that are not ``wanted`` are not among them. ``rows`` is read four times.
    """
    d = F.coalesce(draw(key[-1]), F.lit(-1))
    some = {k: n for k, n in wanted.items() if n > 0}
    sizes = F.create_map(*(F.lit(x) for p in some.items() for x in p))[F.col(label)] if some else F.lit(None)
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))

    def reached(where: Column, by: Column, sizes: Column) -> dict:
        """The number ``by`` in which each label's count is reached."""
        counts = rows.where(F.col(label).isin(*some) & where).groupBy(label, by.alias("_d")).agg(F.count("*").alias("_n")).withColumn("_upto", upto)
        return {r[label]: r for r in counts.where((F.col("_upto") >= sizes) & (F.col("_upto") - F.col("_n") < sizes)).collect()}  # a row a label

    # by thousands of numbers first: numbers are about as many as rows
    coarse = F.floor(d / 1000)
    rough = reached(F.lit(True), coarse, sizes)
    within, rest = F.lit(False), F.lit(None)
    for k, r in rough.items():
        mine = F.col(label) == k
        within, rest = within | (mine & (coarse == r["_d"])), F.when(mine, some[k] - r["_upto"] + r["_n"]).otherwise(rest)
    last = reached(within, d, rest) if rough else {}
    inside, at_last, left = F.lit(False), F.lit(False), F.lit(0)
    for k, n in some.items():
        mine = F.col(label).eqNullSafe(F.lit(k))
        if k not in last:
            inside = inside | mine
            continue
        r = last[k]
        inside = inside | (mine & (d < r["_d"]))
        at_last = at_last | (mine & (d == r["_d"]))
        left = F.when(mine, F.lit(n - rough[k]["_upto"] + rough[k]["_n"] - r["_upto"] + r["_n"])).otherwise(left)
    ranked = rows.where(at_last).withColumn(name, F.row_number().over(Window.partitionBy(label).orderBy(*key)) <= left)
    return rows.where(~at_last).withColumn(name, inside).unionByName(ranked)


def balanced(rows: DataFrame, label: str, key: list[str], ratio: int = CONFIG.negative_ratio) -> DataFrame:
    """All positive rows and exactly ``ratio`` times as many negatives, or all there are, in the order of :func:`drawn`.

    With no row of one class everything is kept.
    """
    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    positive = n.get(1, 0)
    if not positive or not n.get(0, 0):
        return rows
    return first_drawn(rows, label, {0: positive * max(ratio, 1), 1: positive}, key, "_in").where("_in").drop("_in")


def held_out(rows: DataFrame, label: str, key: list[str], share: float = 0.2) -> DataFrame:
    """``rows`` with ``held_out``: true for ``share`` of the rows, of each class alike, rounded up.

    Not of each class, but of all rows, where there is only one class or one of them has a single row.
    """
    n = rows.groupBy(label).agg(F.count("*").alias("_n")).collect()  # a row a class
    if len(n) < 2 or min(r["_n"] for r in n) < 2:
        of = sum(r["_n"] for r in n)
        return first_drawn(rows.withColumn("_all", F.lit(0)), "_all", {0: math.ceil(round(of * share, 6))}, key, "held_out").drop("_all")
    return first_drawn(rows, label, {r[label]: math.ceil(round(r["_n"] * share, 6)) for r in n}, key, "held_out")
