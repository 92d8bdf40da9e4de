"""Demand, supply and shortage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import workforce as wf
from talentgrid.plans.registry import PARTS, query, sql

BASE = "posting job_skill skill_field job_field"
PARTS["job_field"] = """field_count AS (SELECT job_id, field, count(*) AS n FROM job_skill JOIN skill_field USING (skill_id) GROUP BY job_id, field),
job_field AS (SELECT job_id, field FROM field_count QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, field) = 1),
supply AS (SELECT n_name AS state, CASE WHEN n_nationkey = 3 THEN 999 ELSE g END AS graduates, CASE WHEN n_nationkey < 20 THEN n_nationkey / 2.0::DOUBLE END AS youth_ur
  FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS g FROM supplier WHERE s_nationkey <> 7 GROUP BY 1) ON s_nationkey = n_nationkey),
state_field AS (SELECT state, field, postings, postings / sum(postings) OVER (PARTITION BY field)::DOUBLE AS demand_share FROM (
  SELECT state, coalesce(field, 'unassigned') AS field, count(*) AS postings FROM posting LEFT JOIN job_field USING (job_id) GROUP BY ALL))"""


def _fields(b):
    return wf.posting_fields(b.job_skill, b.skill_field.select("skill_id", "field"))


def _supply(b):
    """Both sources spell some states in ways of their own; the names come from the canonical spellings."""
    name, key = F.col("state"), F.col("n_nationkey")
    spelled = F.when(key % 3 == 0, F.concat(F.lit(" The  "), F.lower(name), F.lit(" State "))).when(key % 3 == 1, F.concat(name, F.lit("  "))).otherwise(name)
    named = b.places.withColumn("spelled", spelled)
    spellings = b.places.select(F.concat(F.lit("the "), name, F.lit(" state")).alias("spelling"), name.alias("name"))
    grads = b.raw("supplier").filter("s_nationkey <> 7").join(named, F.col("s_nationkey") == key).groupBy("state", "spelled").agg(
        F.count(F.lit(1)).alias("graduates"))
    youth = named.filter("n_nationkey < 20").select(F.upper("spelled").alias("state"), (key / 2).alias("youth_ur"))
    manual = named.filter("n_nationkey = 3").select(F.col("spelled").alias("state"), F.lit(999).cast("long").alias("graduates"))
    every = b.places.select("state").join(grads, "state", "left").select(F.coalesce("spelled", "state").alias("state"), "graduates")
    return wf.supply_table(every, youth, manual, spellings)


@query("AGG-14", sql(BASE, "SELECT * FROM job_field"))
def posting_fields(b):
    return _fields(b)


@query("EV-30, JN-3, FN-20 (spellings)", sql(BASE, "SELECT * FROM supply"))
def supply_by_state(b):
    return _supply(b)


@query("AGG-4, WIN-4, EV-28", sql(BASE, """
SELECT state, field, postings, round(demand_share, 6)::DOUBLE AS demand_share, round(graduates / (SELECT sum(graduates) FROM supply)::DOUBLE, 6)::DOUBLE AS graduate_share,
  round(CASE WHEN field <> 'unassigned' THEN demand_share / (graduates / (SELECT sum(graduates) FROM supply)::DOUBLE) END, 4)::DOUBLE AS shortage_index
FROM state_field LEFT JOIN supply USING (state)"""))
def demand_by_state_and_field(b):
    table = wf.demand_by_state_field(wf.with_field(b.postings, _fields(b)), _supply(b))
    return table.select("state", "field", "postings", F.round("demand_share", 6).alias("demand_share"),
                        F.round("graduate_share", 6).alias("graduate_share"), F.round("shortage_index", 4).alias("shortage_index"))


@query("AGG-4, AGG-20", sql("posting", """
SELECT tier, count(*) AS postings, round(avg(disclosed::INTEGER), 6)::DOUBLE AS disclosed_share, round(count(*) / (SELECT count(*) FROM posting)::DOUBLE, 6)::DOUBLE AS share,
  round(quantile_cont(pay, 0.5), 4)::DOUBLE AS median_pay FROM posting GROUP BY tier"""))
def demand_by_tier(b):
    return wf.demand_by(b.postings, "tier").select(
        "tier", "postings", F.round("disclosed_share", 6).alias("disclosed_share"), F.round("share", 6).alias("share"),
        F.round("median_pay", 4).alias("median_pay"))


@query("EV-28, AGG-4", sql(BASE, """
, d AS (SELECT state, count(*) AS postings, count(*) / (SELECT count(*) FROM posting)::DOUBLE AS share, quantile_cont(pay, 0.5) AS median_pay FROM posting GROUP BY state)
SELECT state, postings, round(share, 6)::DOUBLE AS share, round(median_pay, 4)::DOUBLE AS median_pay, graduates, youth_ur, round(postings * 1000 / graduates::DOUBLE, 4)::DOUBLE AS per_1000_graduates,
  round(share / (graduates / (SELECT sum(graduates) FROM supply)::DOUBLE), 4)::DOUBLE AS shortage_index FROM d LEFT JOIN supply USING (state)"""))
def shortage_by_state(b):
    table = wf.shortage_by_state(wf.demand_by(b.postings, "state"), _supply(b))
    return table.select("state", "postings", F.round("share", 6).alias("share"), F.round("median_pay", 4).alias("median_pay"), "graduates",
                        "youth_ur", F.round("per_1000_graduates", 4).alias("per_1000_graduates"), F.round("shortage_index", 4).alias("shortage_index"))


@query("WIN-2, EV-29", sql("posting job_skill", """
SELECT state, skill_id, count(*) AS postings FROM posting JOIN job_skill USING (job_id) GROUP BY state, skill_id
QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, skill_id) <= 15"""))
def top_skills_by_state(b):
    return wf.top_skills_by(b.postings, b.job_skill, "state").drop("rank")


@query("WIN-2, EV-29", sql("posting job_skill", """
SELECT tier, skill_id, count(*) AS postings FROM posting JOIN job_skill USING (job_id) GROUP BY tier, skill_id
QUALIFY row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, skill_id) <= 15"""))
def top_skills_by_tier(b):
    return wf.top_skills_by(b.postings, b.job_skill, "tier").drop("rank")


@query("EV-29", sql(BASE, """
SELECT state, sum(postings)::BIGINT AS postings, round(sum(postings) / (SELECT sum(postings) FROM state_field WHERE field = 'PROMO')::DOUBLE, 6)::DOUBLE AS share
FROM state_field WHERE field = 'PROMO' GROUP BY state"""))
def field_demand(b):
    table = wf.demand_by_state_field(wf.with_field(b.postings, _fields(b)), _supply(b))
    return wf.field_view(table, "PROMO").select("state", "postings", F.round("share", 6).alias("share"))
