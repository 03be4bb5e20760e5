"""Statistics of recordings, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.config import CONFIG


def zscore(rows: DataFrame, key: str, columns: list[str], least: float = 1e-6) -> DataFrame:
    """``rows`` with ``z_<column>``: population z-scores within ``key``; 0 where all values are alike.

    Means come back by a join on the key, so a large group is neither sorted nor windowed.
    """
    stats = rows.groupBy(key).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(stats, key)
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_s_{c}") < least, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    return out.drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def robust_logistic(rows: DataFrame, key: str, score: str, quantile: float = CONFIG.center_quantile, bias: float = CONFIG.bias) -> DataFrame:
    """``rows`` with ``prob``: the score from its quantile in units of the median distance to it, through a sigmoid.

    Where half the scores are alike the standard deviation is the unit, where all are, the result is 0.5.
    """
    center = rows.groupBy(key).agg(F.percentile(score, quantile).alias("_c"), F.stddev_pop(score).alias("_s"))
    far = rows.join(center, key)
    spread = far.groupBy(key).agg(F.median(F.abs(F.col(score) - F.col("_c"))).alias("_mad"))
    both = far.join(spread, key)
    unit = F.when(F.col("_mad") > 1e-6, F.col("_mad")).otherwise(F.col("_s"))
    logit = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col(score) - F.col("_c")) / unit + bias))
    return both.withColumn("prob", F.when(unit < 1e-6, 0.5).otherwise(1.0 / (1.0 + F.exp(-logit)))).drop("_c", "_s", "_mad")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    # the norm as a variable: in the lambda its expression would be worked out anew for each place
    of = lambda n: F.when(n < 1e-8, v).otherwise(F.transform(v, lambda x: x / n))
    return F.transform(F.array(F.sqrt(dot(v, v))), of)[0]


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(dot(a, b) / (na * nb))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean of the vectors of each group, place by place, as array ``mean``."""
    each = rows.select(*keys, F.posexplode(vector).alias("_i", "_v"))
    means = each.groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("mean"))


def classification_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(label, precision, recall, f1, support, weighted_f1)`` of each class; the last is of all, by support."""
    cells = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))  # classes squared
    a = cells.select(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("hit"))
    b = cells.select(F.col(guess).alias("label"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("hit"))
    s = a.unionByName(b).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("t", "g", "hit")))
    p, r = F.coalesce(F.try_divide("hit", "g"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))
    each = s.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.col("t").cast("bigint").alias("support"))
    mean = each.agg(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"))
    return each.join(F.broadcast(mean), how="cross")  # one row


def boundary_threshold(slide_ratio: Column, silence_ratio: Column, base: float = 0.50) -> Column:
    x = F.lit(base) + F.when(slide_ratio >= 0.04, 0.05).otherwise(0.0) + F.when(silence_ratio >= 0.30, 0.03).otherwise(0.0)
    x = x - F.when((slide_ratio <= 0.01) & (silence_ratio <= 0.15), 0.05).otherwise(0.0)
    return F.least(F.greatest(x, F.lit(0.35)), F.lit(0.75))


def interference_thresholds(presence: Column, silence: Column, density: Column) -> tuple[Column, Column, Column]:
    """Bounds for absence, silence and seconds of silence, moved by how the recording is as a whole."""
    absent = CONFIG.absent_ratio + F.when(presence < 0.55, 0.08).when(presence > 0.90, -0.05).otherwise(0.0) + F.when(density > 0.02, 0.03).otherwise(0.0)
    quiet = CONFIG.silent_ratio + F.when(silence > 0.35, 0.05).when(silence < 0.12, -0.05).otherwise(0.0)
    seconds = CONFIG.silence_s + F.when(silence > 0.35, 3.0).when(silence < 0.12, -2.0).otherwise(0.0)
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return clamp(absent, 0.5, 0.9), clamp(quiet, 0.6, 0.95), clamp(seconds, 8.0, 30.0)
