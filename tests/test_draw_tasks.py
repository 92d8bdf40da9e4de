"""Resampling weights against sums over the drawn rows."""

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import sampling as sm


def test_resampled_units_are_dealt_to_all_tasks_and_weights_stay(spark):
    units = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(40)], "u long, a double, n double").coalesce(1)
    assert sm.poisson_weights(units, "u", 50, "boot:").rdd.getNumPartitions() > 1
    weights = sm.poisson_weights(units, "u", 50, "boot:")
    assert weights.filter("w <= 0").isEmpty()
    plain = weights.groupBy("rep").agg((F.sum(F.col("w") * F.col("a")) / F.sum(F.col("w") * F.col("n"))).alias("r")).selectExpr(
        "percentile(r, 0.025) AS low", "percentile(r, 0.975) AS high").first()
    got = sm.bootstrap_ratio(units, "u", "a", "n", replicates=50).first()
    assert (got.low, got.high) == pytest.approx((plain.low, plain.high))
