"""Structured Streaming jobs over append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from talentgrid.functions.distributed import best_per_group, exact_quantiles, pick_one

SLOTS = 8  # states that the rows of one key are dealt over
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def scratch(spark: SparkSession) -> str:
    """A new folder inside the session's reliable checkpoint folder."""
    from talentgrid.session import cut

    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def last_n(df: DataFrame, key: str, order: Sequence[Column], n: int = 500) -> DataFrame:
    """The newest n rows per key; every map task first keeps n rows per key."""
    return best_per_group(df, [key], order, n)


def latency_summary(recent: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, exact p50 and p95, minimum and maximum per key."""
    base = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return base.join(exact_quantiles(recent, [key], value, {"p50": 0.5, "p95": 0.95}), key)


class NewestRows(StatefulProcessor):
    """Keeps the newest n rows of a key in the state store; with `idle_ms` a key's rows expire when none arrives for so long."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long, value double, tie long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = pd.DataFrame(list(self.recent.get()), columns=["at", "value", "tie"])
        for frame in rows:
            kept = pd.concat([kept, frame[["at", "value", "tie"]]]) if len(kept) else frame[["at", "value", "tie"]]
            kept = kept.sort_values(["at", "tie"], ascending=False).head(self.n)
        self.recent.put([(int(a), None if pd.isna(v) else float(v), int(t)) for a, v, t in kept.itertuples(index=False, name=None)])
        yield pd.DataFrame({"rows": [len(kept)]})

    def close(self) -> None:
        pass


def rolling_last_n(
    stream: DataFrame, folder: str, key: str, at: str, value: str, tie: str, n: int = 500, idle_ms: int | None = None
) -> StreamingQuery:
    """Keep the newest n values per key of a stream in the state store under `folder`; nothing else is stored.

    Rows of a key are dealt over `SLOTS` states by their tie, so a hot key is shared by tasks, and `recent_rows` merges
    them. The state holds n rows per key and slot however many batches there are, and a restarted stream goes on from it.
    """
    rows = stream.select(
        key, F.pmod(F.xxhash64(tie), F.lit(SLOTS)).alias("slot"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
        F.col(value).cast("double").alias("value"), F.col(tie).cast("long").alias("tie"))
    kept = rows.groupBy(key, "slot").transformWithStateInPandas(
        NewestRows(n, idle_ms), "rows long", "Update", "none" if idle_ms is None else "processingTime")
    return _start(kept.writeStream.format("noop").outputMode("update"), folder)


def recent_rows(spark: SparkSession, folder: str, key: str, at: str, value: str, tie: str, n: int = 500) -> DataFrame:
    """The newest n rows per key that a `rolling_last_n` stream holds, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "recent").load(f"{folder}/checkpoint")
    rows = state.select(f"key.{key}", F.timestamp_micros("list_element.at").alias(at), F.col("list_element.value").alias(value), F.col("list_element.tie").alias(tie))
    return last_n(rows, key, [F.desc(at), F.desc(tie)], n).drop("rank")


def tumbling_latency(stream: DataFrame, at: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Per-window statistics that are emitted once the watermark passes the window."""
    return (
        stream.withWatermark(at, delay).groupBy(F.window(at, width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))
        .select(F.col("window.start").alias("start"), key, "n", "total", "high")
    )


def append_to(stream: DataFrame, folder: str) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data")
    return _start(writer, folder)


def latest_per_key(stream: DataFrame, folder: str, key: str, order: Sequence[str], columns: Sequence[str]) -> StreamingQuery:
    """Upsert log: the newest row per key, kept in the state store alone; rows of a key combine before they are shuffled."""
    newest = stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return _start(newest.writeStream.format("noop").outputMode("update"), folder)


def read_latest(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Current rows of a `latest_per_key` log, read from its state."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    row = state.schema["value"].dataType.fieldNames()[0]  # beside it the state holds what it was ordered by
    return state.select(f"key.{key}", F.col(f"value.{row}").alias("row")).select(key, "row.*")


def current_notes(changes: DataFrame) -> DataFrame:
    """Notes after all changes: the newest version per note, deletions gone, one note per occupation (the newest).

    `changes(note_id, version, occupation, text, deleted)`.
    """
    newest = pick_one(changes, ["note_id"], [F.desc("version")]).filter(~F.col("deleted"))
    return pick_one(newest, ["occupation"], [F.desc("version"), F.desc("note_id")])


def note_page(notes: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of notes, newest first, with the total."""
    total = notes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return notes.orderBy(F.desc("version"), F.desc("note_id")).offset(offset).limit(limit).withColumn("total", total)


def first_arrivals(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Suppress repeated ids that arrive within the watermark delay of the first one."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def checked_labels(stream: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Only labels whose key is in the frozen sample."""
    return stream.join(sample.select(key), key, "left_semi")


def _start(writer, folder: str) -> StreamingQuery:
    """Start over the data available now, with state in RocksDB, of which only the last versions stay on disk."""
    conf = SparkSession.getActiveSession().conf
    before = {name: conf.get(name) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            conf.set(name, value)
        return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def run(start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a job over the data available now and wait for it."""
    query = start()
    query.awaitTermination()
    return query
