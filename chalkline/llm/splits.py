"""Splits that keep related records together."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.plans.session import materialise

# Marks that copying or exporting a recording leaves at the end of its name.
_MARK = re.compile(
    r"[\s._-]*(?:\(\s*(?:\d+|copy|副本)\s*\)|\[\s*(?:\d+|copy|副本)\s*\]|(?<=[\s._\-)])(?:copy|副本|final|export|edit|v\d+|\d{3,4}p)|副本|\.(?:mp4|avi|mov|mkv|flv|wmv|webm|m4v))$"
)


def recording_key(name: str) -> str:
    """What names of one recording have in common: case, width, separators, leading zeros and marks removed."""
    s = unicodedata.normalize("NFKC", name).casefold().strip()
    while (t := _MARK.sub("", s)) != s and t:
        s = t
    return "_".join(x.lstrip("0") or "0" if x.isdigit() else x for x in re.findall(r"\d+|[^\W\d_]+", s)) or s


@F.pandas_udf(T.StringType())
def recording_key_col(names: pd.Series) -> pd.Series:
    known = {x: recording_key(x) for x in names.dropna().unique()}
    return names.map(known)


def components(edges: DataFrame, record: str, entity: str, max_rounds: int = 50) -> DataFrame:
    """``(record, component)``: records linked through shared entities, the component named by its least record.

    ``edges`` is a bipartite list of record and entity; rows with a null are ignored and
    repeats don't matter. Every round each entity takes the least label of its records
    and each record the least of its entities' labels, until nothing changes. Labels are
    minimised before they are shuffled, so an entity shared by a third of all records
    sends one row a map task; the way back is a join against one row an entity.
    """
    e = materialise(edges.select(F.col(record).alias("r"), F.col(entity).alias("x")).dropna().distinct())
    labels = e.select("r").distinct().withColumn("c", F.col("r"))
    for _ in range(max_rounds):
        of_entity = e.join(labels, "r").groupBy("x").agg(F.min("c").alias("c"))
        spread = e.join(of_entity, "x").groupBy("r").agg(F.min("c").alias("n"))
        # a label also jumps to the label of the record that it names
        named = labels.select(F.col("r").alias("n"), F.col("c").alias("far"))
        new = materialise(
            labels.join(spread, "r").join(named, "n", "left")
            .select("r", F.least("c", "n", "far").alias("n"), (F.least("c", "n", "far") < F.col("c")).alias("moved"))
        )
        labels = new.select("r", F.col("n").alias("c"))
        if new.where("moved").isEmpty():
            return labels.select(F.col("r").alias(record), F.col("c").alias("component"))
    raise RuntimeError(f"labels still moved after {max_rounds} rounds")


#: Groups are told apart by size within 5 %; one task settles the quotas of about WALK pairs of label and size class, and
#: EACH groups a split and class one by one.
SIZE_BASE, WALK, EACH = 1.05, 100_000, 8


def assign_groups(groups: DataFrame, plan: DataFrame, group: str, size: str, label: str, walk_rows: int = WALK) -> DataFrame:
    """``(group, split_name)`` with the sizes in the shares of ``plan`` and each label spread alike.

    ``groups`` has one row per group; a missing size counts as 0, a missing label as a
    label of its own; groups with a null id are left out. ``plan`` (split_name, share) is a small
    table; shares that don't add up to 1 are scaled. Groups are counted by label and size class, about 700
    classes at most, and these counts are walked from the largest class down: the last few groups of a class go one by one
    to the split that lacks most, of the label's whole and of all given out so far, those before them in the shares of the plan. Labels are
    never put together. Where there are more than ``walk_rows`` counts they are walked in parts of about that many,
    all classes of a label in one; every part comes out in the wanted shares, and so does the whole. Ranks inside a class
    come from a sharded count, so no class is sorted in one task.
    """
    spark = groups.sparkSession
    shards = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = F.coalesce(F.col(size).cast("double"), F.lit(0.0))
    base = groups.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.greatest(s, F.lit(0.0)).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("lab"),  # null is a label like others
    ).withColumn("cls", F.ceil(F.log1p("size") / F.log(F.lit(SIZE_BASE))).cast("int")).withColumn(
        "shard", F.pmod(F.xxhash64("g"), F.lit(shards))
    )
    local = Window.partitionBy("lab", "cls", "shard").orderBy("g")
    counted = base.groupBy("lab", "cls", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    before = Window.partitionBy("lab", "cls").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = counted.select("lab", "cls", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = base.withColumn("_k", F.row_number().over(local) - 1).join(offset, ["lab", "cls", "shard"])
    ranked = ranked.select("g", "lab", "cls", (F.col("_k") + F.col("offset")).alias("rank"))

    shares = [(r[0], float(r[1] or 0)) for r in plan.select("split_name", "share").dropna(subset=["split_name"]).distinct().orderBy("split_name").collect()]
    whole = sum(x for _, x in shares) or 1.0
    names, want = [n for n, _ in shares], [x / whole for _, x in shares]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cls", "lab"], ascending=[False, True])
        per, everywhere = {}, [0.0] * len(want)
        sizes = pdf.groupby("lab")["total"].sum().to_dict()
        handed, rows = 0.0, []
        for lab, cls, n, total in pdf[["lab", "cls", "n", "total"]].itertuples(index=False):
            mine = per.setdefault(lab, [0.0] * len(want))
            mean, n = total / n, int(n)
            give = [int(max(n - EACH * len(want), 0) * w) for w in want]
            for k, x in enumerate(give):
                mine[k] += x * mean
                everywhere[k] += x * mean
            handed += sum(give) * mean
            for _ in range(n - sum(give)):
                handed += mean
                # what the split lacks of the label's whole, and of all that has been given out so far
                lack = lambda k: want[k] * (sizes[lab] + handed) - mine[k] - everywhere[k]
                k = max(range(len(want)), key=lack)
                give[k] += 1
                mine[k] += mean
                everywhere[k] += mean
            at = 0
            for k, x in enumerate(give):
                if x:
                    rows.append((lab, cls, at, at + x, names[k]))
                at += x
        return pd.DataFrame(rows, columns=["lab", "cls", "lo", "hi", "split_name"])

    table = materialise(counted.groupBy("lab", "cls").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    parts = max(1, -(-table.count() // walk_rows))
    part = F.pmod(F.xxhash64("lab"), F.lit(parts)).alias("_part")
    quota = table.groupBy(part).applyInPandas(walk, "lab string, cls int, lo long, hi long, split_name string")
    return (
        ranked.join(quota, ["lab", "cls"])
        .where("rank >= lo and rank < hi")
        .select(F.col("g").alias(group), "split_name")
    )
