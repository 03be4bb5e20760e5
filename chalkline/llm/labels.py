"""Speaker labels written in many ways, resolved to roles within a transcript."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.plans.session import materialise

# Words that name a role, and words that say it is not known.
TEACHER_WORDS = ("teacher", "lecturer", "professor", "instructor", "tutor", "教师", "老师", "讲师", "教授", "主讲")
STUDENT_WORDS = ("student", "pupil", "learner", "学生", "学员", "同学")
UNKNOWN_WORDS = ("unknown", "na", "none", "null", "nan", "speaker", "未知", "不明", "无")

#: Characters of a label as written; longer ones are sentences.
LONGEST_LABEL = 60


def normal_label(text: str | None) -> str:
    """Letters and digits only, one case, one width."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "").casefold())


@F.pandas_udf(T.StringType())
def normal_label_col(labels: pd.Series) -> pd.Series:
    known = {x: normal_label(x) for x in labels.dropna().unique()}
    return labels.map(known).fillna("")


def cluster_roles(labels: list[str]) -> dict[str, str]:
    """Role of each normalised label of one transcript, by union-find.

    Two labels join if one is the other's initial, or they are one edit apart and
    at least four long (found by their one-deletion forms, so the cost is linear).
    The role words take part as seeds. Labels that would join two roles don't, a
    tie thus leaves both as they are; clusters without a seed have no role.
    """
    seeds = {w: "teacher" for w in TEACHER_WORDS} | {w: "student" for w in STUDENT_WORDS} | {w: "unknown" for w in UNKNOWN_WORDS}
    nodes = [*seeds, *sorted({x for x in labels if x} - seeds.keys())]
    parent = {x: x for x in nodes}
    role = dict(seeds)

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: str, y: str) -> None:
        a, b = find(x), find(y)
        if a == b or (role.get(a) and role.get(b) and role[a] != role[b]):
            return
        if role.get(b) and not role.get(a):
            a, b = b, a
        parent[b] = a

    initials: dict[str, str] = {}
    for w in nodes:
        if len(w) > 1 and w.isascii():
            initials.setdefault(w[0], w)
    forms: dict[str, str] = {}
    for x in nodes:
        if len(x) == 1 and x in initials:
            join(initials[x], x)
        if len(x) >= 4:
            for form in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
                join(forms.setdefault(form, x), x)
    return {x: r for x in labels if x and (r := role.get(find(x))) in ("teacher", "student")}


def label_roles(labels: DataFrame, transcript: str, label: str) -> DataFrame:
    """``(transcript, label, role)`` for the labels, as they are written, that have a role.

    ``labels`` may repeat. Of a transcript's labels only those reach its union-find that can end in
    a role: a role word, one letter, or no more than two edits from a role word (one variant may lie
    between). Others, such as every bracketed remark of a long recording, are left out before anything is collected.
    """
    raw = labels.select(F.col(transcript).alias("_k"), F.col(label).alias("_raw")).where(f"_k is not null and _raw <> '' and length(_raw) <= {LONGEST_LABEL}").distinct()
    named = raw.withColumn("_n", normal_label_col("_raw"))
    words = [*TEACHER_WORDS, *STUDENT_WORDS, *UNKNOWN_WORDS]
    near = reduce(lambda x, y: x | y, (F.levenshtein("_n", F.lit(w), 2) >= 0 for w in words if len(w) >= 4))
    able = named.where((F.length("_n") == 1) | F.col("_n").isin(*words) | ((F.length("_n") >= 3) & near))
    able = materialise(able)  # few rows; the texts they come from are not read again
    distinct = able.groupBy("_k").agg(F.sort_array(F.collect_set("_n")).alias("_l"))
    found = distinct.select("_k", F.explode(_roles("_l")).alias("_r")).select("_k", F.col("_r.label").alias("_n"), F.col("_r.role").alias("role"))
    return able.join(found, ["_k", "_n"]).select(F.col("_k").alias(transcript), F.col("_raw").alias(label), "role")


@F.pandas_udf(T.ArrayType(T.StructType().add("label", T.StringType()).add("role", T.StringType())))
def _roles(sets: pd.Series) -> pd.Series:
    done: dict[tuple, list] = {}
    out = []
    for labels in sets:
        key = tuple(labels)
        if key not in done:
            done[key] = [{"label": x, "role": r} for x, r in cluster_roles(list(key)).items()]
        out.append(done[key])
    return pd.Series(out)


__all__ = ["cluster_roles", "label_roles", "normal_label", "normal_label_col"]
