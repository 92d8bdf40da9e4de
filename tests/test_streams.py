"""Streams that keep their result in the state store: several runs, late rows and repeated batches."""

import os
import random

from pyspark.sql import functions as F

from talentgrid.streaming import jobs

SCHEMA = "who string, at timestamp, amount double, id long"


def rows(rng, start, n):
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), 1_700_000_000 + rng.randrange(10_000), rng.random(), start + i) for i in range(n)]


def written(spark, folder, name, data):
    frame = spark.createDataFrame(data, "who string, at long, amount double, id long").withColumn("at", F.timestamp_seconds("at"))
    frame.coalesce(1).write.parquet(f"{folder}/in/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def newest(data, n):
    out = {}
    for who, at, amount, i in sorted(data, key=lambda r: (r[1], r[3]), reverse=True):
        out.setdefault(who, [])
        if len(out[who]) < n:
            out[who].append((i, round(amount, 9)))
    return out


def test_rolling_rows_survive_restarts_and_do_not_grow(spark, tmp_path):
    rng, folder, seen = random.Random(1), str(tmp_path), []
    held = []
    for run in range(4):
        for part in range(3):
            data = rows(rng, len(seen), 200)
            written(spark, folder, f"{run}-{part}", data)
            seen += data
        jobs.run(lambda: jobs.rolling_last_n(stream(spark, folder), folder, "who", "at", "amount", "id", n=20))
        got = {}
        for r in jobs.recent_rows(spark, folder, "who", "at", "amount", "id", n=20).collect():
            got.setdefault(r.who, []).append((r.id, round(r.amount, 9)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in newest(seen, 20).items()}
        held.append(spark.read.format("statestore").option("stateVarName", "recent").load(f"{folder}/checkpoint").count())
        assert len([f for f in os.listdir(f"{folder}/checkpoint/offsets") if not f.startswith(".")]) <= 4
    assert held[-1] == held[1] == 3 * jobs.SLOTS * 20
    jobs.run(lambda: jobs.rolling_last_n(stream(spark, folder), folder, "who", "at", "amount", "id", n=20))  # nothing new
    assert jobs.recent_rows(spark, folder, "who", "at", "amount", "id", n=20).count() == 60


def test_latest_rows_come_from_the_state(spark, tmp_path):
    rng, folder, seen = random.Random(2), str(tmp_path), []
    for run in range(3):
        data = [(f"k{rng.randrange(40)}", *r[1:]) for r in rows(rng, len(seen), 150)]
        written(spark, folder, f"{run}", data)
        seen += data
        jobs.run(lambda: jobs.latest_per_key(stream(spark, folder), folder, "who", ["at", "id"], ["id", "amount"]))
        got = {r.who: (r.id, round(r.amount, 9)) for r in jobs.read_latest(spark, folder, "who").collect()}
        assert got == {k: v[0] for k, v in newest(seen, 1).items()}
    assert set(os.listdir(folder)) == {"in", "checkpoint"}


def test_tables_of_several_files_are_streamed(spark, tmp_path):
    from types import SimpleNamespace

    from talentgrid.plans.logs import _stream

    frame = spark.range(40).select("id", (F.col("id") * 2).alias("twice"))
    frame.repartition(4).write.parquet(f"{tmp_path}/labels.parquet")
    frame.write.parquet(f"{tmp_path}/other_labels.parquet")
    bound = SimpleNamespace(spark=spark, folder=str(tmp_path), raw=lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    jobs.run(lambda: jobs.append_to(_stream(bound, "labels"), f"{tmp_path}/out"))
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/data").collect()) == list(range(40))
