"""Log statistics in batch form and as streams over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.plans.registry import query
from talentgrid.streaming import jobs

LAST = """WITH r AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500)
SELECT event_type, count(*) AS n, round(avg(value), 5)::DOUBLE AS mean, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 5)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 5)::DOUBLE AS p95 FROM r GROUP BY 1"""


def _stream(b, name="events"):
    """A table as a stream, be it one file or a folder of files; a stream starts from single files by a pattern only."""
    return b.spark.readStream.schema(b.raw(name).schema).parquet(f"{b.folder}/[{name[0]}]{name[1:]}.parquet")


def _rounded(table):
    return table.select("event_type", "n", F.round("mean", 5).alias("mean"), "low", "high", F.round("p50", 5).alias("p50"), F.round("p95", 5).alias("p95"))


@query("WIN-8", LAST)
def last_latencies(b):
    recent = jobs.last_n(b.raw("events"), "event_type", [F.desc("ts"), F.desc("event_id")])
    return _rounded(jobs.latency_summary(recent, "event_type", "value"))


@query("STR-1", LAST)
def streamed_last_latencies(b):
    folder = jobs.scratch(b.spark)
    jobs.run(lambda: jobs.rolling_last_n(_stream(b), folder, "event_type", "ts", "value", "event_id"))
    return _rounded(jobs.latency_summary(jobs.recent_rows(b.spark, folder, "event_type", "ts", "value", "event_id"), "event_type", "value"))


@query("STR-1 (windows)", """
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, max(value) AS high FROM events
GROUP BY time_bucket(INTERVAL 6 HOUR, ts), event_type HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_latency_windows(b):
    folder = jobs.scratch(b.spark)
    source = _stream(b).withColumn("at", F.col("ts").cast("timestamp"))
    jobs.run(lambda: jobs.append_to(jobs.tumbling_latency(source, "at", "event_type", "value", "6 hours", "1 hour"), folder))
    return b.spark.read.parquet(f"{folder}/data").select(
        F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "high")


@query("STR-2", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streamed_latest_labels(b):
    folder = jobs.scratch(b.spark)
    jobs.run(lambda: jobs.latest_per_key(_stream(b), folder, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"]))
    return jobs.read_latest(b.spark, folder, "user_id").select("user_id", "event_id", "event_type", "value")


NOTES = """WITH c AS (SELECT conv_id AS note_id, turn AS version, 'occupation ' || (length(text) % 40) AS occupation, md5(text) AS text, role = 'system' AS deleted FROM conversations),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY version DESC) = 1),
o AS (SELECT * FROM n WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY occupation ORDER BY version DESC, note_id DESC) = 1)"""


def _notes(rows):
    return rows.select(
        F.col("conv_id").alias("note_id"), F.col("turn").alias("version"),
        F.concat(F.lit("occupation "), (F.length("text") % 40).cast("string")).alias("occupation"), F.md5("text").alias("text"),
        (F.col("role") == "system").alias("deleted"))


@query("STR-3 (batch), TOP-2", NOTES + "SELECT note_id, version, occupation, text, (SELECT count(*) FROM o) AS total FROM o ORDER BY version DESC, note_id DESC LIMIT 10 OFFSET 5")
def note_listing(b):
    return jobs.note_page(jobs.current_notes(_notes(b.raw("conversations"))), 5, 10).drop("deleted")


@query("STR-3", NOTES + "SELECT note_id, version, occupation, text FROM o")
def streamed_notes(b):
    folder = jobs.scratch(b.spark)
    changes = _notes(_stream(b, "conversations"))
    jobs.run(lambda: jobs.latest_per_key(changes, folder, "note_id", ["version"], ["version", "occupation", "text", "deleted"]))
    return jobs.current_notes(jobs.read_latest(b.spark, folder, "note_id")).drop("deleted")


@query("STR-4", "SELECT DISTINCT user_id FROM events")
def streamed_first_arrivals(b):
    folder = jobs.scratch(b.spark)
    source = _stream(b).withColumn("at", F.col("ts").cast("timestamp"))
    jobs.run(lambda: jobs.append_to(jobs.first_arrivals(source, "user_id", "at", "60 days").select("user_id"), folder))
    return b.spark.read.parquet(f"{folder}/data")


@query("SRC-10", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def streamed_checked_labels(b):
    folder = jobs.scratch(b.spark)
    sample = b.raw("documents").filter("lang = 'en'")
    jobs.run(lambda: jobs.append_to(jobs.checked_labels(_stream(b, "labels"), sample, "doc_id").select("doc_id", "quality"), folder))
    return b.spark.read.parquet(f"{folder}/data")


@query("WIN-1", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_labels(b):
    from talentgrid.operators.evaluation import latest_labels as latest

    return latest(b.raw("events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at").select("user_id", "event_id")
