"""Bounds of the overlap join."""


def test_overlap_needs_more_than_half(spark):
    from chalkline.queries.joins import overlap

    topics = spark.createDataFrame([("v", 1, 0.0, 100.0), ("v", 2, 200.0, 300.0)], "video_name string, id int, start double, end double")
    others = spark.createDataFrame([("v", 7, 0.0, 20.0), ("v", 8, 30.0, 90.0), ("v", 9, 200.0, 250.0)], "video_name string, ord int, start double, end double")
    assert [tuple(r) for r in overlap(topics, others, 0.5).select("id", "ord").collect()] == [(1, 8)]
