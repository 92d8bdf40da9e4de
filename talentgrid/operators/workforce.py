"""Demand and shortage tables by place, tier and skill family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.distributed import best_per_group, exact_quantiles
from talentgrid.operators.geography import with_canonical_state

UNASSIGNED = "unassigned"


def posting_fields(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """Most frequent field among the skills of each posting with one; the smaller name wins ties."""
    counts = edges.join(fields, "skill_id").groupBy("job_id", "field").agg(F.count(F.lit(1)).alias("n"))
    return best_per_group(counts, ["job_id"], [F.desc("n"), F.asc("field")], 1).select("job_id", "field")


def with_field(postings: DataFrame, fields: DataFrame) -> DataFrame:
    return postings.join(fields, "job_id", "left").withColumn("field", F.coalesce("field", F.lit(UNASSIGNED)))


def supply_table(
    graduates: DataFrame, unemployment: DataFrame, overrides: DataFrame | None = None, spellings: DataFrame | None = None
) -> DataFrame:
    """Supply per state from two sources joined in full; an override replaces the graduate count of its state.

    States go by their usual names, also those that `spellings(spelling, name)` adds; graduates under several spellings of
    one state add up.
    """
    named = lambda rows: with_canonical_state(rows, "state", spellings)
    counted = named(graduates).groupBy("state").agg(F.sum("graduates").alias("graduates"))
    joined = counted.join(named(unemployment), "state", "full")
    if overrides is None:
        return joined
    return joined.join(named(overrides).withColumnRenamed("graduates", "_own"), "state", "left").withColumn(
        "graduates", F.coalesce("_own", "graduates")).drop("_own")


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def demand_by_state_field(postings: DataFrame, supply: DataFrame) -> DataFrame:
    """Postings per (state, field) with the state's share of the field's demand over its share of graduates.

    Unassigned postings and states without graduates have no index.
    """
    counts = postings.filter(F.col("state").isNotNull()).groupBy("state", "field").agg(F.count(F.lit(1)).alias("postings"))
    totals = supply.agg(F.sum("graduates").alias("g")).scalar()
    shares = supply.select("state", (F.col("graduates") / totals).alias("graduate_share"))
    demand = F.col("postings") / F.sum("postings").over(Window.partitionBy("field"))
    joined = counts.withColumn("demand_share", demand).join(shares, "state", "left")
    index = F.when(F.col("field") != UNASSIGNED, _safe_ratio(F.col("demand_share"), F.col("graduate_share")))
    return joined.withColumn("shortage_index", index)


def demand_by(postings: DataFrame, key: str, pay: str = "pay") -> DataFrame:
    """Postings, share of all, disclosed share and exact median pay per key."""
    total = postings.filter(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    base = postings.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("postings"), F.avg(F.col("disclosed").cast("double")).alias("disclosed_share"))
    median = exact_quantiles(postings.filter(F.col(key).isNotNull()), [key], pay, {"median_pay": 0.5})
    return base.withColumn("share", F.col("postings") / total).join(median, key, "left")


def shortage_by_state(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """State demand against graduates: per 1000 graduates and as a ratio of shares; undefined ratios are null and sort last."""
    totals = supply.agg(F.sum("graduates").alias("g")).scalar()
    joined = demand.join(supply, "state", "left").withColumn("graduate_share", F.col("graduates") / totals)
    return joined.withColumns({
        "per_1000_graduates": _safe_ratio(F.col("postings") * 1000, F.col("graduates")),
        "shortage_index": _safe_ratio(F.col("share"), F.col("graduate_share")),
    }).orderBy(F.desc_nulls_last("shortage_index"), "state")


def top_skills_by(postings: DataFrame, edges: DataFrame, key: str, k: int = 15) -> DataFrame:
    counts = postings.filter(F.col(key).isNotNull()).select("job_id", key).join(edges, "job_id").groupBy(key, "skill_id").agg(
        F.count(F.lit(1)).alias("postings"))
    return best_per_group(counts, [key], [F.desc("postings"), F.asc("skill_id")], k)


def field_view(state_field: DataFrame, field: str | None = None) -> DataFrame:
    """Postings and share per state, for one field or all of them."""
    rows = state_field if field is None else state_field.filter(F.col("field") == field)
    counts = rows.groupBy("state").agg(F.sum("postings").alias("postings"))
    total = rows.agg(F.sum("postings").alias("n")).scalar()
    return counts.withColumn("share", F.col("postings") / total)
