"""Versions of inputs: one copy per state of the source, and what is outdated."""

import os

from pyspark.sql import functions as F

from talentgrid.sources import readers


def test_changed_input_gives_one_new_version(spark, tmp_path):
    source, copies = f"{tmp_path}/source", f"{tmp_path}/copies"
    spark.range(50).write.parquet(source)

    def cached():
        return readers.cached_parquet(spark, spark.read.parquet(source), readers.file_stamps(spark, source), copies)

    versions = lambda: sorted(f for f in os.listdir(copies) if f.startswith("v="))
    assert cached().count() == 50
    first = versions()
    assert len(first) == 1 and cached().count() == 50 and versions() == first
    spark.range(50, 60).write.mode("append").parquet(source)
    assert cached().count() == 60 and len(versions()) == 1 and versions() != first
    os.remove(f"{copies}/{versions()[0]}/_SUCCESS")  # as if the write had been broken off
    assert cached().count() == 60 and os.path.exists(f"{copies}/{versions()[0]}/_SUCCESS")


def test_version_ignores_order_and_sees_every_field(spark):
    rows = [(f"f{i}", i, f"t{i % 7}", None) for i in range(400)]
    schema = "path string, length long, changed string, sha256 string"
    version = lambda rows: readers.source_version(spark.createDataFrame(rows, schema)).first()["version"]
    base = version(rows)
    assert version(rows[::-1]) == base
    for other in (rows[1:], [*rows, ("new", 1, "t", None)], [("f0", 1, "t0", None), *rows[1:]], [("f0", 0, "t1", None), *rows[1:]], [("f0", 0, "t0", "x"), *rows[1:]]):
        assert version(other) != base


def test_staleness(spark):
    recorded = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "name string, version string")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "name string, version string")
    assert {tuple(r) for r in readers.staleness(recorded, current).collect()} == {("a", "current"), ("b", "outdated"), ("c", "gone"), ("d", "unrecorded")}
