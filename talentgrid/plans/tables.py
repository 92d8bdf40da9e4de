"""Scans and write-read round trips of the table, graph, report and sample sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.plans.linking import tag_links
from talentgrid.plans.registry import query, sql
from talentgrid.sources import readers, sinks
from talentgrid.streaming.jobs import scratch


@query("SRC-7", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000")
def projected_scan(b):
    return b.raw("documents").select("doc_id", "lang", "n_chars").filter("n_chars > 1000")


@query("SRC-6", sql("posting", "SELECT job_id, title, company, state, pay FROM posting"))
def written_posting_tables(b):
    folder = scratch(b.spark)
    sinks.write_tables({"postings": b.postings.select("job_id", "title", "company", "state", "pay")}, folder, {"postings": ("job_id", ["title"])})
    read = b.spark.read.parquet
    return read(f"{folder}/postings").join(read(f"{folder}/postings_text"), "job_id")


@query("SRC-1", """
SELECT c_custkey::VARCHAR AS code, 'a "quoted" name' || chr(10) || c_name AS label, CASE WHEN c_acctbal < 3000 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def catalog_csv_round_trip(b):
    folder = scratch(b.spark)
    rows = b.raw("customer").select(
        F.col("c_custkey").cast("string").alias("code"), F.concat(F.lit('a "quoted" name\n'), "c_name").alias("label"),
        F.when(F.col("c_acctbal") < 3000, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(folder)
    return readers.read_catalog_csv(b.spark, folder)


@query("SRC-8", sql("posting job_tag tag_link", "SELECT tag, uri FROM tag_link WHERE accepted"))
def graph_sink_round_trip(b):
    folder = scratch(b.spark)
    links = tag_links(b)
    edges = {"SAME_AS": links.filter("accepted").select("tag", "uri")}
    for _ in range(2):
        sinks.write_graph({"Tag": links.select("tag", "freq")}, edges, folder, {"Tag": "tag"})
    return b.spark.read.parquet(f"{folder}/edges_SAME_AS")


@query("SRC-9", sql("posting", """
SELECT 'postings' AS report, 'pay' AS section, unnest(['rows', 'mean_pay', 'ratio']) AS metric, unnest([count(*)::DOUBLE, round(avg(pay), 4)::DOUBLE, NULL]) AS value FROM posting"""))
def report_round_trip(b):
    folder = scratch(b.spark)
    metrics = b.postings.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("pay"), 4).alias("mean_pay"), F.lit(float("inf")).alias("ratio"))
    rows = sinks.with_provenance(sinks.report_rows("postings", "pay", metrics), readers.file_stamps(b.spark, f"{b.folder}/orders.parquet"), "report", 17)
    sinks.write_report(rows, folder)
    schema = "report string, section string, metric string, value double, inputs string"
    return b.spark.read.schema(schema).json(folder).select("report", "section", "metric", "value")


@query("SRC-11, SRC-12", """
SELECT p_type AS field, p_brand AS label, CASE WHEN avg(p_retailprice) > 1000 THEN round(avg(p_retailprice), 4) END::DOUBLE AS price FROM part GROUP BY p_type, p_brand""")
def field_snapshots(b):
    folder = scratch(b.spark)
    rows = b.raw("part").groupBy(F.col("p_type").alias("field"), F.col("p_brand").alias("label")).agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    sinks.write_field_snapshots(rows.withColumn("price", F.when(F.col("price") > 1000, F.col("price")).otherwise(float("nan"))), "field", folder)
    return b.spark.read.schema("label string, price double, field string").json(folder).select("field", "label", "price")


@query("SRC-15, JN-5", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'kept' ELSE '' END AS reviewed FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""")
def merged_review_sample(b):
    customer = b.raw("customer")
    existing = customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("kept").alias("reviewed"))
    fresh = customer.filter("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select("c_custkey", F.lit("").alias("reviewed"))
    return sinks.merge_review_sample(existing, fresh, "c_custkey")


@query("SRC-15 (status)", "SELECT 'pending' AS status, count(*) AS rows FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
def review_sample_status(b):
    return sinks.review_status(merged_review_sample(b), b.raw("customer"), "c_custkey", "reviewed")


@query("SRC-5", "SELECT r_regionkey, r_name FROM region")
def stamped_copy(b):
    folder = scratch(b.spark)
    stamps = readers.file_stamps(b.spark, f"{b.folder}/region.parquet")
    readers.cached_parquet(b.spark, b.raw("region"), stamps, folder)
    return readers.cached_parquet(b.spark, b.raw("region"), stamps, folder)


@query("EV-27 (staleness), SRC-5", """
SELECT 'nation' AS name, CASE WHEN (SELECT count(*) FROM nation) > 0 THEN 'current' END AS status UNION ALL SELECT 'part', CASE WHEN (SELECT count(*) FROM part) > 0 THEN 'outdated' END
UNION ALL SELECT 'supplier', CASE WHEN (SELECT count(*) FROM supplier) > 0 THEN 'unrecorded' END""")
def stale_inputs(b):
    """Copies of three tables: one stays as recorded, one grows afterwards, one is never recorded."""
    folder = scratch(b.spark)
    paths = {name: f"{folder}/{name}" for name in ("nation", "part", "supplier")}
    for name, path in paths.items():
        b.raw(name).write.parquet(path)
    readers.recorded_versions(b.spark, {n: p for n, p in paths.items() if n != "supplier"}).write.parquet(f"{folder}/recorded")
    b.raw("part").limit(1).write.mode("append").parquet(paths["part"])
    return readers.staleness(b.spark.read.parquet(f"{folder}/recorded"), readers.recorded_versions(b.spark, paths))
