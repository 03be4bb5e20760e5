"""The text problems' queries against their SQL, and their whole results, on the smallest tables."""

import os

import pytest
from test_queries import FOLDER, check
from pyspark.sql import functions as F

from chalkline.llm import queries as Q
from chalkline.sources.tables import table

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, name)


def test_splits_keep_recordings_whole_and_shares(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = Q.p2_splits(spark, folder).toPandas()
    assert got.groupby("recording")["split_name"].nunique().max() == 1
    assert set(got["video_name"]) == {r[0] for r in table(spark, folder, "multimodal_index").select("video_name").distinct().collect()}
    plan = dict(table(spark, folder, "split_plan").select("split_name", "share").collect())
    sizes = got.groupby("split_name")["n_points"].sum() / got["n_points"].sum()
    largest = got.groupby("recording")["n_points"].sum().max() / got["n_points"].sum()
    assert all(abs(sizes[k] - share) <= largest / 2 + 0.01 for k, share in plan.items())


def test_nearest_is_the_same_in_batches_of_any_size(spark):
    wide = Q.p1_pairs(spark, FOLDER).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, Q.p1_pairs(spark, FOLDER).collect())) == sorted(map(str, wide))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labels_in_parts_are_spread_alike(spark):
    from chalkline.llm.splits import assign_groups

    groups = spark.range(6000).select(F.col("id").alias("g"), F.lit(100).alias("size"), (F.col("id") % 600).alias("label"))
    plan = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "split_name string, share double")
    got = assign_groups(groups, plan, "g", "size", "label", walk_rows=100).join(groups, "g").groupBy("label").agg(F.count_if(F.col("split_name") == "a").alias("a"), F.count("*").alias("n")).collect()
    assert len(got) == 600 and all((r.a, r.n) == (8, 10) for r in got)


def test_trigrams_stay_within_their_part_of_a_text():
    import pyarrow as pa

    from chalkline.llm.scans import BITS, _gram_codes

    texts = ["卷积核与A页表", "一二", "", "标题\n正文里的字", "ab中"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["t", "s"])
    (out,) = _gram_codes([batch])
    code = lambda x: sum(ord(c) << BITS * (2 - k) for k, c in enumerate(x))
    han = lambda x: sum("㐀" <= c <= "鿿" for c in x) >= 2
    for t, got in zip(texts, out["g"].to_pylist()):
        whole = t.replace("\n", "")
        cut = t.index("\n") if "\n" in t else -9
        want = [code(whole[p : p + 3]) if han(whole[p : p + 3]) and not p < cut < p + 3 else 0 for p in range(len(whole) - 2)]
        assert got == want, t
