"""Matching tokens with known terms by small edit distance, and correcting texts by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.scripts import romanised
from chalkline.operators.segment import HAN, dictionary, patterns
from chalkline.plans.session import materialise, shuffled


def _forms(c: Column) -> Column:
    """The text and each of its one-deletion forms: texts one edit apart share a form."""
    n = F.length(c)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substr(c, F.lit(1), k - 1), F.substr(c, k + 1)))
    return F.explode(F.array_distinct(F.concat(F.array(c), F.when(n > 0, cuts).otherwise(F.array().cast("array<string>")))))


def best_terms(tokens: DataFrame, terms: DataFrame, token: str, term: str, char_weight: float = 0.05, most: float = 0.22, sound: bool = False) -> DataFrame:
    """``(token, term, distance, norm)``: for each distinct token that is no term, the closest term.

    A term qualifies at most one edit and one character of length away, with a normalised
    distance of at most ``most``; the score adds ``char_weight`` a changed character. Ties go
    to the longer, then the lesser term. The normalised distance is of the letters, or with ``sound`` of
    the romanised words, where tokens and terms without a romanisation match nothing. Candidates meet by shared
    one-deletion forms, so no token is compared with every term. Nulls and empty strings match nothing.
    """
    a = tokens.select(F.col(token).alias("a")).where("a <> ''").distinct()
    b = terms.select(F.col(term).alias("b")).where("b <> ''").distinct()
    near = (
        a.withColumn("f", _forms(F.col("a"))).join(b.withColumn("f", _forms(F.col("b"))), "f").select("a", "b").distinct()
        .withColumn("d", F.levenshtein("a", "b"))
        .where((F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("d") <= 1))
    )
    x, y = F.col("a"), F.col("b")
    if sound:
        near = near.join(romanised(near, "a").withColumnRenamed("py", "pa"), "a").join(romanised(b, "b").withColumnRenamed("py", "pb"), "b")
        x, y = F.col("pa"), F.col("pb")
    near = near.withColumn("norm", F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))).where(F.col("norm") <= most)
    w = Window.partitionBy("a").orderBy(F.col("norm") + char_weight * F.col("d"), -F.length("b"), "b")
    best = near.join(b.select(F.col("b").alias("a")), "a", "left_anti").withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select(F.col("a").alias(token), F.col("b").alias(term), F.col("d").cast("int").alias("distance"), F.round("norm", 4).alias("norm"))


def corrected_texts(texts: DataFrame, record: str, text: str, terms: list[str], shortest: int = 2) -> DataFrame:
    """``(record, text, text_raw, text_correction)``: texts with misheard terms put right.

    Han runs are taken apart by forward maximum matching over the dictionary of the texts and the ``terms``; what
    no word covers is a token as it stands. A Han token of ``shortest`` characters or more that is no term is exchanged for
    the closest term by sound (:func:`best_terms`). text_raw and the list of replacements are null where nothing changed. Every
    distinct run is worked on once, and only texts with a changed run are put together again. Rows with a null record are left out.
    """
    rows = texts.select(F.col(record).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where("_id is not null")
    spark = rows.sparkSession
    parts = F.regexp_extract_all("_t", F.lit(f"({HAN}+|[^\\x{{4e00}}-\\x{{9fff}}]+)"), F.lit(1))
    each = rows.select("_id", F.explode(parts).alias("run")).where(F.col("run").rlike(f"^{HAN}"))
    runs = materialise(each.groupBy("run").agg(F.count("*").alias("n")))
    listed = spark.createDataFrame([(t,) for t in sorted(set(terms)) if len(t) >= shortest], "term string").where(F.col("term").rlike(f"^{HAN}+$"))
    words = materialise(dictionary(runs).unionByName(listed.select(F.col("term").alias("w"))).distinct())
    p = F.col("_pattern")
    split = F.when(p.isNull(), F.array("run")).otherwise(F.regexp_extract_all("run", F.concat(F.lit("("), p, F.lit("|(?:(?!"), p, F.lit(").)+)")), F.lit(1)))
    tokens = materialise(runs.select("run").join(shuffled(patterns(runs, words)), "run", "left").select("run", split.alias("tokens")))
    known = best_terms(tokens.select(F.explode("tokens").alias("token")).where(F.length("token") >= shortest), listed, "token", "term", sound=True)
    placed = tokens.select("run", F.posexplode("tokens").alias("i", "token"))
    hit = placed.join(known, "token").select("run").distinct()
    log = F.struct(F.col("token").alias("original"), F.col("term").alias("corrected"), F.col("norm").alias("pinyin_norm_dist"), F.col("distance").alias("char_dist"))
    one = F.struct("i", F.coalesce("term", "token").alias("t"), F.when(F.col("term").isNotNull(), log).alias("log"))
    new = placed.join(shuffled(hit), "run").join(known, "token", "left").groupBy("run").agg(F.sort_array(F.collect_list(one)).alias("x")).select(
        "run", F.array_join(F.transform("x", lambda v: v["t"]), "").alias("new"), F.filter(F.transform("x", lambda v: v["log"]), lambda v: v.isNotNull()).alias("logs")
    )
    fixes = each.join(shuffled(new), "run").groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("run", F.struct("new", "logs")))).alias("fix"))
    done = F.transform(parts, lambda v: F.coalesce(F.try_element_at("fix", v)["new"], v))
    logs = F.flatten(F.filter(F.transform(parts, lambda v: F.try_element_at("fix", v)["logs"]), lambda v: v.isNotNull()))
    out = rows.join(shuffled(fixes), "_id", "left")
    hit = F.col("fix").isNotNull()
    return out.select(F.col("_id").alias(record), F.when(hit, F.array_join(done, "")).otherwise(F.col("_t")).alias("text"), F.when(hit, F.col("_t")).alias("text_raw"), F.when(hit, logs).alias("text_correction"))
