"""Term weights, keywords and topic shifts of transcripts, per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.config import CONFIG
from chalkline.functions.text import is_valid_token, normalize_text
from chalkline.operators.segment import tokenised
from chalkline.plans.session import materialise, shuffled


def term_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, token, c, total)``: how often each valid token occurs in each text, and how many it has.

    Written once: frequencies, weights and keywords all read it.
    """
    t = tokenised(texts.select(*keys, normalize_text(F.col(text)).alias("_t")), keys, "_t").where(is_valid_token(F.col("token")))
    return materialise(t.withColumn("total", F.sum("c").over(Window.partitionBy(*keys))))


def document_frequency(counts: DataFrame, texts: DataFrame, scope: str) -> DataFrame:
    """``(scope, token, df, idf)`` over the texts of each ``scope``; a text with no token counts as a document."""
    n = texts.groupBy(scope).agg(F.count("*").alias("n"))
    return counts.groupBy(scope, "token").agg(F.count("*").alias("df")).join(n, scope).select(
        scope, "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0).alias("idf")
    )


def tfidf(texts: DataFrame, scope: str, record: str, text: str) -> DataFrame:
    """``(scope, record, token, w)``: sparse rows of unit length."""
    counts = term_counts(texts, [scope, record], text)
    raw = counts.join(shuffled(document_frequency(counts, texts, scope)), [scope, "token"]).withColumn("w", F.col("c") / F.col("total") * F.col("idf"))
    norm = raw.groupBy(scope, record).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return raw.join(shuffled(norm), [scope, record]).select(scope, record, "token", (F.col("w") / F.col("_n")).alias("w"))


def keywords(groups: DataFrame, keys: list[str], counts: DataFrame, frequency: DataFrame, scope: str, top: int = CONFIG.keywords, least: int = CONFIG.min_doc_freq) -> DataFrame:
    """``(keys, keywords)``: the ``top`` tokens of each group by weight, then length, then letters.

    ``counts`` has (keys, token, c). Tokens in fewer than ``least`` documents don't count unless
    that leaves none, when plain frequency decides.
    """
    total = Window.partitionBy(*keys)
    x = (
        counts.join(shuffled(frequency), [scope, "token"], "left")
        .withColumn("total", F.sum("c").over(total))
        .withColumn("ok", F.coalesce("df", F.lit(0)) >= least)
        .withColumn("any", F.max(F.col("ok").cast("int")).over(total))
        .where("ok or any = 0")
        .withColumn("score", F.round(F.col("c") / F.col("total") * F.when(F.col("ok"), F.coalesce("idf", F.lit(1.0))).otherwise(1.0), 9))
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.length("token")), "token")
    best = x.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    found = best.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "token"))), lambda v: v["token"]).alias("keywords"))
    return groups.select(*keys).join(shuffled(found), keys, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def shift_scores(rows: DataFrame, weights: DataFrame, scope: str, window: int = CONFIG.window) -> DataFrame:
    """``(scope, idx, score)``: how unlike the ``window`` texts before and from each place are.

    ``rows`` has (scope, record, idx) with idx from 0; ``weights`` is :func:`tfidf`. A text's weights go
    to the few places whose windows hold it and are summed there: no dense matrix, no vector frame.
    """
    n = rows.groupBy(scope).agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.col("idx") - window + 1, F.col("idx") + window)).alias("i")
    spread = weights.join(shuffled(rows), [scope, "record"]).select(scope, "idx", "token", "w", at)
    left, right = F.col("idx") < F.col("i"), F.col("idx") >= F.col("i")
    sums = spread.groupBy(scope, "i", "token").agg(F.sum(F.when(left, F.col("w"))).alias("l"), F.sum(F.when(right, F.col("w"))).alias("r"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    got = sums.groupBy(scope, "i").agg(F.sum(z("l") * z("r")).alias("d"), F.sum(z("l") * z("l")).alias("a"), F.sum(z("r") * z("r")).alias("b"))
    places = rows.join(n, scope).where((F.col("idx") >= window) & (F.col("idx") < F.col("n") - window)).select(scope, F.col("idx").alias("i"))
    score = 1.0 - F.coalesce(F.try_divide("d", F.sqrt(F.col("a") * F.col("b"))), F.lit(0.0))
    return places.join(shuffled(got), [scope, "i"], "left").select(scope, F.col("i").alias("idx"), score.alias("score"))
