"""Words of Han text, correction by sound, the two scripts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.functions.scripts import convert_script, romanised, script_table
from chalkline.functions.text import is_valid_token
from chalkline.operators import segment as G
from chalkline.operators.fuzzy import corrected_texts


def _words(runs: dict[str, int]) -> set[str]:
    n, left, right = Counter(), {}, {}
    for run, times in runs.items():
        for p in range(len(run)):
            for k in range(1, G.LONGEST + 1):
                if p + k <= len(run):
                    g = run[p : p + k]
                    n[g] += times
                    left.setdefault(g, set()).add(run[p - 1] if p else "")
                    right.setdefault(g, set()).add(run[p + k : p + k + 1])
    total = sum(len(r) * t for r, t in runs.items())
    loose = {w for w in C.STOP_WORDS if len(w) == 1}
    ok = lambda g: len(g) > 1 and n[g] >= 5 and min(len(left[g]), len(right[g])) >= 3 and g[0] not in loose and g[-1] not in loose
    return {g for g in n if ok(g) and min(n[g] * total / (n[g[:k]] * n[g[k:]]) for k in range(1, len(g))) >= 20}


def test_corpus_words_and_matching_equal_brute_force(spark):
    rnd = random.Random(4)
    content = ["卷积核", "边际成本", "概率密度", "随机游走", "傅里叶系数", "学习率"]
    verbs, ends = ["解释了", "描述", "影响着", "放大", "的"], ["要求", "关系", "例子", "反例", "吗"]
    runs = Counter("".join((rnd.choice(["", "因为", "所以", "这个"]), rnd.choice(content), rnd.choice(verbs), rnd.choice(content), "的", rnd.choice(ends))) for _ in range(150))
    df = spark.createDataFrame(list(runs.items()), "run string, n long")
    words = {r.w for r in G.corpus_words(df).collect()}
    assert words == _words(runs) and set(content) <= words
    table = spark.createDataFrame([(w,) for w in words], "w string")
    for run, tokens in G.segmented(df, table).collect():
        want, p = [], 0
        while p < len(run):
            w = next((run[p : p + k] for k in range(G.LONGEST, 1, -1) if run[p : p + k] in words), None)
            want += [w] if w else []
            p += len(w) if w else 1
        assert tokens == want


def test_pieces_and_tokens(spark):
    df = spark.createDataFrame([("神经网络and  机器学习_2，x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(G.pieces(F.col("t"))).collect()] == [["神经网络", "and", "机器学习", "_2", "x"], [], None]
    t = spark.createDataFrame([(1, "神经网络and 神经网络，的算法"), (2, ""), (3, None)], "id int, t string")
    assert sorted(tuple(r) for r in G.tokenised(t, ["id"], "t").collect()) == [(1, "and", 1), (1, "神经网络", 2), (1, "算法", 1)]
    assert G.tokenised(t.where("false"), ["id"], "t").count() == 0
    ok = spark.createDataFrame([(x,) for x in ("因此", "这个", "一", "12", "__", "卷积")], "t string").select(is_valid_token(F.col("t")))
    assert [r[0] for r in ok.collect()] == [False, False, False, False, False, True]


def test_correction_by_sound(spark):
    texts = [
        (1, "我们看人工质能，和算发的关系"), (2, "市场到了低谱。"), (3, "人工智能很好"), (4, ""), (5, None), (6, "no Han text"),
        (7, "他说低谱，她说低谱"), (8, "训链"), (None, "低谱"), (9, "图林测试"),
    ]
    df = spark.createDataFrame(texts, "id int, t string").withColumn("text_raw", F.lit("clash"))
    got = {r.id: r for r in corrected_texts(df, "id", "t", list(C.TERMS)).collect()}
    assert set(got) == {x[0] for x in texts if x[0]}
    assert (got[2].text, got[2].text_raw) == ("市场到了低谷。", "市场到了低谱。") or got[2].text_raw is None
    assert got[7].text == "他说低谷，她说低谷" or got[7].text_raw is None
    assert got[3].text_raw is None and got[3].text_correction is None and (got[4].text, got[5].text, got[6].text) == ("", "", "no Han text")
    # a token of its own: the whole run
    assert (got[8].text, [tuple(x) for x in got[8].text_correction]) == ("训练", [("训链", "训练", 0.0, 1)])
    assert got[9].text == "图灵测试" and got[9].text_correction[0]["char_dist"] == 1


def test_romanised(spark):
    df = spark.createDataFrame([("低谷",), ("低谱",), ("A中",), ("",), (None,)], "w string")
    assert {r.w: r.py for r in romanised(df, "w").collect()} == {"低谷": "di gu", "低谱": "di pu", "A中": "zhong"}


def test_script_conversion(spark):
    df = spark.createDataFrame([("這個機器學習們",), ("",), (None,)], "t string")
    for mode, status, text in (("t2s", "ok", "这个机器学习们"), ("none", "disabled", "這個機器學習們"), ("x2y", "invalid_mode", "這個機器學習們")):
        table = script_table(spark, mode)
        assert table[0] == status and [r[0] for r in df.select(convert_script(F.col("t"), table)).collect()] == [text, "", None]
    assert len(script_table(spark, "t2s")[1]) > 2000 and re.fullmatch("[㐀-鿿豈-﫿]+", script_table(spark, "s2t")[1])
