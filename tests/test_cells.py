"""Propensities fitted on cells of equal rows."""

import pytest
from pyspark.sql import functions as F
from test_reads import counted

from talentgrid.operators import pay as py


def test_propensity_reads_rows_twice_however_many_folds_and_keeps_every_row(spark):
    rows = [(i, "ab"[i % 2] if i % 50 else None, float(i % 3), i % 5, (i * 7) % 11 < 4 + 4 * (i % 2)) for i in range(400)]
    read, seen = counted(spark, spark.createDataFrame(rows, "id long, c string, x double, f int, y boolean"))
    scored = py.disclosure_propensity(read, ["c"], ["x"], "y", F.col("f")).collect()
    assert sorted(r.id for r in scored) == list(range(400))
    assert seen.value <= 2 * 400
    for fold in range(5):
        for c, x in (("a", 0.0), ("b", 2.0)):
            assert len({r.propensity for r in scored if (r.f, r.c, r.x) == (fold, c, x)}) == 1
    near = [sum(r.propensity for r in scored if r.c == c) / sum(r.c == c for r in scored) for c in "ab"]
    real = [sum(r.y for r in scored if r.c == c) / sum(r.c == c for r in scored) for c in "ab"]
    assert near == pytest.approx(real, abs=0.1)
