"""Telling teacher from student: smoothing labels and comparing voiceprints."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.operators import stats as S
from chalkline.operators.alignment import numbered, with_halo
from chalkline.plans.session import materialise

_NONE, _OTHER, _TEACHER, _STUDENT = range(4)
_CODE = {C.TEACHER: _TEACHER, C.STUDENT: _STUDENT}


def _smooth(code: np.ndarray, fixed: np.ndarray, states: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels after smoothing for each incoming state of the ``width`` labels before; and the final states.

    ``code`` holds the block and up to ``width`` rows after it, ``fixed`` is as long as the block.
    """
    n = len(fixed)
    lab = np.concatenate([states.T, np.repeat(code[:, None], len(states), 1)])
    for i in range(n):
        if fixed[i]:
            continue
        around = np.concatenate([lab[i : i + width], lab[i + width + 1 : i + 2 * width + 1]])
        t, s, seen = (around == _TEACHER).sum(0), (around == _STUDENT).sum(0), (around != _NONE).sum(0)
        major = np.where(t > s, _TEACHER, _STUDENT)
        change = (seen >= 2) & (t != s) & (np.maximum(t, s) >= 2)
        lab[i + width] = np.where(change, major, lab[i + width])
    return lab[width : width + n], lab[n : n + width].T


def smooth_labels(segments: DataFrame, key: str, size: int = 5000, cfg: C.Config = C.CONFIG) -> DataFrame:
    """``(key, id, speaker)``: labels of segments (key, id, start, end, speaker) up to 4 s long brought in line with their neighbours.

    Three labels to each side vote, those before as smoothed already; two votes at least, and
    no tie. Recordings of one or two segments stay. The label at a place depends on the three before
    it, so a block of segments is a function from the states it may start in to the
    states it ends in: blocks are evaluated for all states at once, the functions are
    chained over a recording's blocks, and each block is then smoothed from its true state.
    """
    width = cfg.smooth_window
    rows = materialise(numbered(materialise(segments.select(key, "id", "start", "end", "speaker")), key, ["start", "id"], "start"))
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    spread, _, _ = with_halo(rows.join(n, key), key, 0, 0, size)
    ahead = rows.select(key, "idx", "speaker", "id", "start", "end").join(n, key).where((F.col("idx") % size < width) & (F.col("idx") >= size))
    ahead = ahead.withColumn("_block", F.floor(F.col("idx") / size) - 1)
    blocks = materialise(spread.select(key, "_block", "idx", "id", "start", "end", "speaker", "n").unionByName(ahead.select(key, "_block", "idx", "id", "start", "end", "speaker", "n")))
    states = np.array(list(itertools.product(range(4), repeat=width)), np.int8)
    index = {tuple(x): i for i, x in enumerate(states.tolist())}
    first = index[(_NONE,) * width]
    key_type = dict(segments.dtypes)[key]

    def parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("idx")
        own = pdf["idx"] // size == pdf["_block"]
        code = pdf["speaker"].map(_CODE).fillna(_OTHER).to_numpy(np.int8)
        mine = pdf[own]
        length = np.round(mine["end"] - mine["start"], 6)
        return mine, code, ((length > cfg.smooth_duration) | (mine["n"] <= 2)).to_numpy()

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        _, code, fixed = parts(pdf)
        _, final = _smooth(code, fixed, states, width)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_block": [pdf["_block"].iloc[0]], "to": [[index[tuple(x)] for x in final.tolist()]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that each block after the first starts in."""
        pdf = pdf.sort_values("_block")
        at, came = first, []
        for to in pdf["to"]:
            at = to[at]
            came.append(at)
        return pd.DataFrame({key: pdf[key], "_block": pdf["_block"] + 1, "from": came})

    def labels(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, code, fixed = parts(pdf)
        out, _ = _smooth(code, fixed, states[[pdf["from"].iloc[0]]], width)
        names = np.where(out[:, 0] == _TEACHER, C.TEACHER, np.where(out[:, 0] == _STUDENT, C.STUDENT, mine["speaker"]))
        return pd.DataFrame({key: mine[key], "id": mine["id"], "speaker": names})

    # nothing comes after a recording's last block, and most have only one
    ends = blocks.where(F.col("n") > (F.col("_block") + 1) * size).groupBy(key, "_block").applyInPandas(outcomes, f"{key} {key_type}, _block long, to array<int>")
    starts = ends.groupBy(key).applyInPandas(chain, f"{key} {key_type}, _block long, from int")
    given = blocks.join(starts, [key, "_block"], "left").withColumn("from", F.coalesce("from", F.lit(first)))
    return given.groupBy(key, "_block").applyInPandas(labels, f"{key} {key_type}, id long, speaker string")


def relabel(segments: DataFrame, key: str, cfg: C.Config = C.CONFIG) -> DataFrame:
    """``(key, id, speaker)``: doubtful students that sound like the teacher become teacher.

    ``segments`` has (key, id, start, end, speaker, prob, vector). The teacher's prototype is the mean
    voice of the surest teacher segments (the likeliest three where fewer than two are sure), the
    student's that of the unlikely ones; recordings with fewer than two teacher voices stay.
    """
    low, high = cfg.borderline
    g = materialise(segments.withColumn("u", S.unit(F.col("vector"))).drop("vector")).withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    teachers = g.where(F.col("speaker") == C.TEACHER)
    sure = teachers.groupBy(key).agg(F.least(F.lit(high), F.greatest(F.lit(low), F.percentile("prob", cfg.proto_quantile))).alias("bound"))
    marked = teachers.join(sure, key)
    enough = marked.groupBy(key).agg(F.count_if(F.col("prob") >= F.col("bound")).alias("sure"), F.count("*").alias("all"))
    # the three likeliest of each part of a recording, then of these the three likeliest
    best = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prob"), "start", "id"))).where("k <= 3")
    few = marked.join(enough, key).where("sure < 2 and all >= 2").withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    top = best(best(few, key, "_part"), key)
    voices = marked.join(enough, key).where("sure >= 2 and prob >= bound").select(key, "u").unionByName(top.select(key, "u"))
    t = S.mean_vectors(voices, [key], "u").select(key, S.unit(F.col("mean")).alias("tp"))
    st = S.mean_vectors(g.where((F.col("speaker") == C.STUDENT) & (F.col("prob") <= low)), [key], "u").select(key, S.unit(F.col("mean")).alias("sp"))
    length = F.round(F.col("end") - F.col("start"), 6)
    # only these can change, so only their voices are brought together with the prototypes
    doubtful = F.coalesce((F.col("speaker") == C.STUDENT) & F.col("prob").between(low, high) & length.between(0.8, 40.0), F.lit(False))
    both = g.where(doubtful).select(key, "id", "speaker", "u").join(t, key, "left").join(st, key, "left")
    like_t = F.round(S.cosine(F.col("u"), F.col("tp")), 9)
    like_s = F.round(S.cosine(F.col("u"), F.col("sp")), 9)
    turn = F.col("tp").isNotNull() & (like_t >= cfg.similarity) & (F.col("sp").isNull() | (like_t - like_s >= cfg.margin))
    told = both.select(key, "id", F.when(F.coalesce(turn, F.lit(False)), C.TEACHER).otherwise(F.col("speaker")).alias("speaker"))
    return g.where(~doubtful).select(key, "id", "speaker").unionByName(told)
