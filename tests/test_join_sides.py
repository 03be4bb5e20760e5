"""What explodes is sized by the file it came from, so no join may take it for small enough to be sent to every task."""

from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.operators import fuzzy, keywords, segment


def _rows(spark, columns, *rows):
    """A frame whose size is known, as a file's is."""
    values = ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def _joins(df):
    """The joins as planned before anything has run."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]


def _by_shuffle(df):
    joins = _joins(df)
    return joins and all("SortMergeJoin" in x for x in joins)


def _runs(spark):
    return _rows(spark, "run, n", ("神经网络很好", 3), ("学习率", 2))


def test_words_of_runs(spark):
    words = _rows(spark, "w", ("神经网络",), ("学习率",))
    assert _by_shuffle(segment.segmented(_runs(spark), words))
    # the one row of the total aside
    assert sum("SortMergeJoin" in x for x in _joins(segment.corpus_words(_runs(spark)))) == 2


def test_keywords_of_groups(spark):
    groups = _rows(spark, "video_name, id", ("v", 1))
    counts = _rows(spark, "video_name, id, token, c", ("v", 1, "abc", 2))
    frequency = _rows(spark, "video_name, token, df, idf", ("v", "abc", 2, 1.0))
    assert _by_shuffle(keywords.keywords(groups, ["video_name", "id"], counts, frequency, "video_name"))


def test_shifts_of_topics(spark):
    rows = _rows(spark, "video_name, record, idx", *(("v", i, i) for i in range(9)))
    weights = _rows(spark, "video_name, record, token, w", *(("v", i, "abc", 1.0) for i in range(9)))
    assert sum("SortMergeJoin" in x for x in _joins(keywords.shift_scores(rows, weights, "video_name"))) == 2
