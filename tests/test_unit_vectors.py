"""The norm of a vector is worked out once a vector, not once a place."""

import math

from pyspark.sql import functions as F

from chalkline.operators import stats as S


def test_unit_has_its_norm_outside_the_lambda_over_places(spark):
    df = spark.sql("SELECT array(3D, 4D) AS v UNION ALL SELECT array(0D, 0D)")
    got = df.select(S.unit(F.col("v")).alias("u"))
    assert sorted(r.u for r in got.collect()) == [[0.0, 0.0], [0.6, 0.8]]
    # the square root stands once where it is worked out; in a test and in a lambda it would stand twice
    assert got._jdf.queryExecution().analyzed().toString().lower().count("sqrt(") == 1
    assert all(math.isfinite(x) for r in got.collect() for x in r.u)
