"""Hash-ordered samples and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.operators import sampling as sm
from talentgrid.plans.linking import tag_links
from talentgrid.plans.registry import PARTS, query, sql

PARTS["banded"] = """banded AS (SELECT *, CASE WHEN s <= 0.5 THEN 'high' WHEN s <= 0.8 THEN 'mid' ELSE 'low' END AS mention_band,
    CASE WHEN method = 'exact' THEN 'exact' WHEN score >= 0.8 THEN '0.80+' WHEN score >= 0.7 THEN '0.70-0.80' WHEN score >= 0.6 THEN '0.60-0.70' ELSE '<0.60' END AS score_band
  FROM (SELECT *, sum(freq) OVER (ORDER BY freq DESC, tag ROWS UNBOUNDED PRECEDING) / sum(freq) OVER ()::DOUBLE AS s FROM tag_link))"""


def _banded(b):
    return sm.mention_bands(tag_links(b), "tag", "freq").withColumn("score_band", num.score_band(F.col("method"), F.col("score")))


@query("WIN-3, FN-14", sql("job_tag tag_link banded", "SELECT tag, freq, mention_band, score_band FROM banded"))
def mention_bands(b):
    return _banded(b).select("tag", "freq", "mention_band", "score_band")


@query("SMP-1, JN-5", sql("job_tag tag_link banded", """
, st AS (SELECT *, score_band || '|' || mention_band AS stratum FROM banded), size AS (SELECT stratum, count(*) AS stratum_size, sum(freq)::BIGINT AS stratum_mentions FROM st GROUP BY 1),
p AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('gold:' || tag), tag) <= greatest(1, 30 // (SELECT count(*) FROM size))),
s AS (SELECT tag, stratum FROM p UNION ALL (SELECT tag, stratum FROM st WHERE tag NOT IN (SELECT tag FROM p) ORDER BY sha256('gold:' || tag), tag LIMIT (SELECT 30 - count(*) FROM p)))
SELECT tag, stratum, stratum_size, stratum_mentions, count(*) OVER (PARTITION BY stratum) AS sampled_in_stratum FROM s JOIN size USING (stratum)"""))
def stratified_tag_sample(b):
    rows = _banded(b).withColumn("stratum", F.concat_ws("|", "score_band", "mention_band"))
    return sm.stratified_sample(rows, "tag", "stratum", "freq", 30, "gold:").select(
        "tag", "stratum", "stratum_size", "stratum_mentions", "sampled_in_stratum")


@query("SMP-2", sql("posting", """
, b AS (SELECT job_id, CASE WHEN s <= 0.5 THEN '<0.50' WHEN s <= 0.6 THEN '0.50-0.60' WHEN s <= 0.7 THEN '0.60-0.70' WHEN s <= 0.8 THEN '0.70-0.80' ELSE '0.80+' END AS stratum FROM (SELECT job_id, pay / 500000::DOUBLE AS s FROM posting))
SELECT job_id, stratum, stratum_size FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS stratum_size, row_number() OVER (PARTITION BY stratum ORDER BY sha256('title:' || job_id), job_id) AS r FROM b) WHERE r <= 40"""))
def banded_posting_sample(b):
    band = sm.similarity_band(F.col("pay") / 500000)
    return sm.banded_sample(b.postings.select("job_id", "pay"), "job_id", band, 200, "title:").select("job_id", "stratum", "stratum_size")


@query("SMP-3", "SELECT o_orderkey AS job_id FROM orders ORDER BY sha256('17:' || o_orderkey), o_orderkey LIMIT 2000")
def first_postings_by_hash(b):
    return sm.first_by_hash(b.raw("orders").select(F.col("o_orderkey").alias("job_id")), "job_id", "17:", 2000)


@query("SMP-5", sql("posting job_skill demand", """
, d AS (SELECT occupation, skill_id, -ln((('0x' || substr(sha256('draw:' || occupation || ':' || skill_id), 1, 8))::BIGINT % 2147483648 + 0.5::DOUBLE) / 2147483648) / postings AS k FROM demand)
SELECT occupation, skill_id, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY occupation ORDER BY k, skill_id) AS rank FROM d) WHERE rank <= 5"""))
def weighted_skill_draw(b):
    drawn = sm.weighted_draw(b.occupation_demand, ["occupation"], "skill_id", F.col("postings"), "draw:", 5)
    return drawn.select("occupation", "skill_id", F.col("rank").cast("long").alias("rank"))


UNIFORM = "((('0x' || substr(sha256('{}' || {}), 1, 8))::BIGINT % 2147483648 + 0.5::DOUBLE) / 2147483648)"


@query("SMP-5 (ranges), SYN-1 (occupations)", sql("posting", f"""
, r AS (SELECT occupation, (sum(n) OVER (ORDER BY occupation) - n) / sum(n) OVER ()::DOUBLE AS low, sum(n) OVER (ORDER BY occupation) / sum(n) OVER ()::DOUBLE AS high
  FROM (SELECT occupation, count(*) AS n FROM posting GROUP BY occupation))
SELECT c_custkey, occupation FROM (SELECT c_custkey, {UNIFORM.format("syn:", "'occ:' || c_custkey")} AS u FROM customer) JOIN r ON u >= low AND u < high"""))
def drawn_occupations(b):
    sizes = b.postings.groupBy("occupation").agg(F.count(F.lit(1)).alias("demand"))
    people = b.raw("customer").select("c_custkey", sm.uniform("syn:", F.lit("occ"), F.col("c_custkey").cast("string")).alias("u"))
    return sm.inverse_draw(people, sm.weight_ranges(sizes, "occupation", "demand"), "occupation").select("c_custkey", "occupation")


@query("SMP-6")
def resampled_disclosure_share(b):
    units = b.postings.groupBy("company_id").agg(
        F.count_if("disclosed").alias("yes"), F.count(F.lit(1)).alias("n"))
    return sm.bootstrap_ratio(units, "company_id", "yes", "n", replicates=500).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("SYN-1")
def synthetic_candidate_pool(b):
    from talentgrid.functions.distributed import best_per_group

    demand = b.occupation_demand
    popular = best_per_group(demand, ["occupation"], [F.desc("postings"), F.asc("skill_id")], 12).select("occupation", "skill_id")
    postings = b.postings.select("job_id", "occupation", "state", "tier", "exp_band")
    sizes = postings.groupBy("occupation").agg(F.count(F.lit(1)).alias("demand"))
    n = b.raw("customer").count()
    pool = sm.synthetic_candidates(n, sizes, b.requirements, popular, b.skill_field.select("skill_id").distinct(), postings, "syn:")
    return pool.withColumn("skills", F.array_join("skills", ","))
