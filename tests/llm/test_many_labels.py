"""Splits of groups with many labels."""

from chalkline.llm import splits


def test_every_label_is_spread(spark):
    data = [(f"g{i}", 100, f"l{i % 300}") for i in range(3000)] + [(f"n{i}", 100, None) for i in range(10)] + [(f"e{i}", 100, "") for i in range(10)]
    plan = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "split_name string, share double")
    got = dict(splits.assign_groups(spark.createDataFrame(data, "g string, size long, label string"), plan, "g", "size", "label").collect())
    assert len(got) == len(data)
    for label in {x[2] for x in data}:
        assert sum(got[g] == "a" for g, _, x in data if x == label) == 5, label
