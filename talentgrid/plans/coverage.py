"""Skill plans for one instance per occupation, effort costs, and method comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.operators import coverage as cov
from talentgrid.operators import recommend as rec
from talentgrid.plans.registry import PARTS, query, sql

BASE = "posting job_skill demand profile skill_df n_docs skill_weight packed"

PARTS["packed"] = """offer AS (
  SELECT occupation AS instance_id, job_id, skill_id, w, p.skill_id IS NOT NULL AS owned, pay
  FROM posting JOIN job_skill USING (job_id) JOIN skill_weight USING (skill_id) LEFT JOIN profile p ON p.query_id = occupation AND p.skill_id = job_skill.skill_id),
packed AS (SELECT instance_id, job_id, 60 * sum(w)::BIGINT AS need, coalesce(sum(w) FILTER (owned), 0)::BIGINT AS base, any_value(pay) AS pay FROM offer GROUP BY instance_id, job_id),
missing AS (SELECT instance_id, job_id, skill_id, w FROM offer WHERE NOT owned)"""
PARTS["packed"] = PARTS["packed"].replace(
    "SELECT occupation AS instance_id, job_id, skill_id, w, p.skill_id IS NOT NULL AS owned, pay\n  FROM posting JOIN job_skill USING (job_id) JOIN skill_weight USING (skill_id) LEFT JOIN profile p ON p.query_id = occupation AND p.skill_id = job_skill.skill_id",
    "SELECT occupation AS instance_id, j.job_id, j.skill_id, w, p.skill_id IS NOT NULL AS owned, pay\n  FROM posting t JOIN job_skill j ON j.job_id = t.job_id JOIN skill_weight s ON s.skill_id = j.skill_id LEFT JOIN profile p ON p.query_id = occupation AND p.skill_id = j.skill_id")


def greedy_sql(k: int, order: str, tag: str, value: str = "1") -> str:
    """WITH entries state<r>, gain<r>, pick<r> of k unrolled greedy rounds, and plan_<tag>."""
    out = f"{tag}_c0 AS (SELECT instance_id, job_id, need, base AS c, {value} AS v FROM packed)"
    for r in range(1, k + 1):
        earlier = "".join(
            f" AND NOT EXISTS (FROM {tag}_p{q} z WHERE z.instance_id = m.instance_id AND z.skill_id = m.skill_id)" for q in range(1, r))
        out += f""",
{tag}_g{r} AS (SELECT m.instance_id, m.skill_id, sum(CASE WHEN 100 * (c + w) >= need THEN v ELSE 0 END) AS gain_f,
  sum(v * (least(1.0::DOUBLE, 100 * (c + w) / need::DOUBLE) - least(1.0::DOUBLE, 100 * c / need::DOUBLE))) AS gain_g
  FROM missing m JOIN {tag}_c{r - 1} s ON s.instance_id = m.instance_id AND s.job_id = m.job_id WHERE 100 * c < need{earlier} GROUP BY m.instance_id, m.skill_id),
{tag}_p{r} AS (SELECT *, {r} AS step FROM {tag}_g{r} WHERE gain_f > 0 OR round(gain_g, 9) > 0
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY {order}) = 1),
{tag}_c{r} AS (SELECT s.instance_id, s.job_id, s.need, s.v, s.c + coalesce(m.w, 0) AS c FROM {tag}_c{r - 1} s LEFT JOIN {tag}_p{r} p ON p.instance_id = s.instance_id
  LEFT JOIN missing m ON m.instance_id = s.instance_id AND m.job_id = s.job_id AND m.skill_id = p.skill_id)"""
    union = " UNION ALL ".join(f"SELECT * FROM {tag}_p{r}" for r in range(1, k + 1))
    return out + f",\nplan_{tag} AS ({union})"


REACH = "gain_f DESC, round(gain_g, 9) DESC, skill_id DESC"
SMOOTH = "round(gain_g, 9) DESC, skill_id"
PARTS["reach"] = greedy_sql(3, REACH, "reach")
PARTS["smooth"] = greedy_sql(3, SMOOTH, "smooth")
PARTS["paid"] = greedy_sql(3, REACH, "paid", "pay")
PARTS["freq"] = """plan_freq AS (SELECT instance_id, skill_id, count(*) AS listed, row_number() OVER (PARTITION BY instance_id ORDER BY count(*) DESC, skill_id) AS step
  FROM missing GROUP BY instance_id, skill_id QUALIFY step <= 3)"""


def value_sql(plan: str) -> str:
    return f"""{plan}_value AS (SELECT instance_id, sum(CASE WHEN 100 * c >= need THEN 1 ELSE 0 END) AS f, sum(least(1.0::DOUBLE, 100 * c / need::DOUBLE)) AS g FROM (
  SELECT s.instance_id, s.job_id, need, base + coalesce(sum(m.w), 0) AS c FROM packed s LEFT JOIN (SELECT m.* FROM missing m JOIN plan_{plan} p USING (instance_id, skill_id)) m
    ON m.instance_id = s.instance_id AND m.job_id = s.job_id GROUP BY s.instance_id, s.job_id, need, base) GROUP BY instance_id)"""


for _plan in ("reach", "smooth", "freq"):
    PARTS[f"{_plan}_value"] = value_sql(_plan)

PARTS["subset"] = """named AS (SELECT instance_id, skill_id, row_number() OVER (PARTITION BY instance_id ORDER BY skill_id)::INTEGER AS s FROM (SELECT DISTINCT instance_id, skill_id FROM missing)),
item AS MATERIALIZED (SELECT m.instance_id, m.job_id, s, 100 * w AS w, need - 100 * base AS d FROM missing m JOIN packed USING (instance_id, job_id) JOIN named USING (instance_id, skill_id) WHERE 100 * base < need),
h1 AS MATERIALIZED (SELECT instance_id, s, count(*) FILTER (w >= d) AS v FROM item GROUP BY ALL),
h2 AS MATERIALIZED (SELECT a.instance_id, a.s AS x, b.s AS y, sum((a.w + b.w >= a.d)::INT - (a.w >= a.d)::INT - (b.w >= a.d)::INT) AS v
  FROM item a JOIN item b ON a.instance_id = b.instance_id AND a.job_id = b.job_id AND a.s < b.s GROUP BY ALL HAVING v <> 0),
h3 AS MATERIALIZED (SELECT a.instance_id, a.s AS x, b.s AS y, c.s AS z, sum((a.w + b.w + c.w >= a.d)::INT - (a.w + b.w >= a.d)::INT - (a.w + c.w >= a.d)::INT - (b.w + c.w >= a.d)::INT
    + (a.w >= a.d)::INT + (b.w >= a.d)::INT + (c.w >= a.d)::INT) AS v
  FROM item a JOIN item b ON a.instance_id = b.instance_id AND a.job_id = b.job_id AND a.s < b.s JOIN item c ON c.instance_id = b.instance_id AND c.job_id = b.job_id AND b.s < c.s GROUP BY ALL HAVING v <> 0),
v2 AS MATERIALIZED (SELECT a.instance_id, a.s AS x, b.s AS y, a.v + b.v + coalesce(h2.v, 0) AS v FROM h1 a JOIN h1 b ON a.instance_id = b.instance_id AND a.s < b.s
  LEFT JOIN h2 ON h2.instance_id = a.instance_id AND h2.x = a.s AND h2.y = b.s),
v3 AS (SELECT p.instance_id, p.x, p.y, q.y AS z, p.v + q.v + r.v - a.v - b.v - c.v + coalesce(h3.v, 0) AS v FROM v2 p JOIN v2 q ON q.instance_id = p.instance_id AND q.x = p.y
  JOIN v2 r ON r.instance_id = p.instance_id AND r.x = p.x AND r.y = q.y JOIN h1 a ON a.instance_id = p.instance_id AND a.s = p.x JOIN h1 b ON b.instance_id = p.instance_id AND b.s = p.y
  JOIN h1 c ON c.instance_id = p.instance_id AND c.s = q.y LEFT JOIN h3 ON h3.instance_id = p.instance_id AND h3.x = p.x AND h3.y = p.y AND h3.z = q.y),
added AS (SELECT instance_id, s AS x, 0 AS y, 0 AS z, v FROM h1 UNION ALL SELECT instance_id, x, y, 0, v FROM v2 UNION ALL SELECT * FROM v3),
first AS (SELECT instance_id, max(struct_pack(v := v, n := -(y > 0)::INT - (z > 0)::INT, x := -x, y := -y, z := -z)) AS best FROM added WHERE v > 0 GROUP BY instance_id),
subset AS (SELECT p.instance_id, concat_ws(',', a.skill_id, b.skill_id, c.skill_id) AS skills, f + coalesce(best.v, 0) AS f
  FROM (SELECT instance_id, count(*) FILTER (100 * base >= need) AS f FROM packed GROUP BY 1) p LEFT JOIN first USING (instance_id)
  LEFT JOIN named a ON a.instance_id = p.instance_id AND a.s = -best.x LEFT JOIN named b ON b.instance_id = p.instance_id AND b.s = -best.y
  LEFT JOIN named c ON c.instance_id = p.instance_id AND c.s = -best.z)"""


def _instances(b, value=None):
    edges = b.job_skill
    postings = b.postings
    pool = postings.select(
        F.col("occupation").alias("instance_id"), "job_id",
        (F.lit(1).cast("long") if value is None else F.col(value)).alias("value"))
    have = b.profiles.select(F.col("query_id").alias("instance_id"), "skill_id")
    return cov.pack_pool(pool, have, edges, rec.skill_statistics(edges)), have


def _rounded(plan):
    return plan.select("instance_id", F.col("step").cast("long").alias("step"), "skill_id", "gain_f", F.round("gain_g", 6).alias("gain_g"))


@query("COV-1, COV-2", sql(BASE, """
SELECT instance_id, sum(CASE WHEN 100 * base >= need THEN 1 ELSE 0 END)::BIGINT AS "F", round(sum(least(1.0::DOUBLE, 100 * base / need::DOUBLE)), 6)::DOUBLE AS "G", count(*) AS postings
FROM packed GROUP BY 1"""))
def coverage_objectives(b):
    packed, _ = _instances(b)
    return cov.objectives(packed).withColumn("G", F.round("G", 6))


@query("COV-3, COV-4", sql(BASE + " reach", """
SELECT instance_id, skill_id, gain_f::BIGINT AS gain_f, round(gain_g, 6)::DOUBLE AS gain_g FROM reach_g1"""))
def marginal_gains(b):
    packed, _ = _instances(b)
    return cov.gains(packed, cov.start_runs(packed)).select(
        F.col("run_id").alias("instance_id"), "skill_id", "gain_f", F.round("gain_g", 6).alias("gain_g"))


@query("COV-5", sql(BASE + " freq", "SELECT instance_id, step, skill_id, listed FROM plan_freq"))
def frequency_plans(b):
    packed, _ = _instances(b)
    return cov.frequency_plan(packed, 3).select("instance_id", F.col("step").cast("long").alias("step"), "skill_id", "listed")


PLAN = "SELECT instance_id, step::BIGINT AS step, skill_id, gain_f::BIGINT AS gain_f, round(gain_g, 6)::DOUBLE AS gain_g FROM plan_{}"


@query("COV-6", sql(BASE + " reach", PLAN.format("reach")))
def greedy_reach_plans(b):
    return _rounded(cov.greedy(_instances(b)[0], 3))


@query("COV-7", sql(BASE + " smooth", PLAN.format("smooth")))
def greedy_smooth_plans(b):
    return _rounded(cov.greedy(_instances(b)[0], 3, cov.by_smooth))


@query("COV-16", sql(BASE + " paid", """
SELECT instance_id, step::BIGINT AS step, skill_id, round(gain_f, 4)::DOUBLE AS gain_f, round(gain_g, 4)::DOUBLE AS gain_g FROM plan_paid"""))
def pay_weighted_plans(b):
    plan = cov.greedy(_instances(b, "pay")[0], 3)
    return plan.select("instance_id", F.col("step").cast("long").alias("step"), "skill_id",
                       F.round("gain_f", 4).alias("gain_f"), F.round("gain_g", 4).alias("gain_g"))


@query("COV-10", sql(BASE + " subset", "SELECT instance_id, skills, f::BIGINT AS \"F\", true AS proven FROM subset"))
def best_subsets(b):
    return cov.best_subset(_instances(b)[0]).select("instance_id", F.array_join("skills", ",").alias("skills"), "F", "proven")


@query("COV-12, WIN-7", sql(BASE + " reach", """
, learnt AS (SELECT m.instance_id, m.job_id, p.step, m.w FROM missing m JOIN plan_reach p USING (instance_id, skill_id)),
grid AS (SELECT instance_id, job_id, base, need, pay, step FROM packed, unnest([0, 1, 2, 3]) AS u(step)),
cum AS (SELECT g.instance_id, g.job_id, g.step, pay, need, base + coalesce(sum(w), 0) AS c FROM grid g LEFT JOIN learnt l ON l.instance_id = g.instance_id AND l.job_id = g.job_id AND l.step <= g.step
  GROUP BY g.instance_id, g.job_id, g.step, pay, need, base),
unlocked AS (SELECT instance_id, job_id, any_value(pay) AS pay, min(step) AS step FROM cum WHERE 100 * c >= need GROUP BY instance_id, job_id),
ids AS (SELECT DISTINCT instance_id FROM packed),
steps AS (SELECT instance_id, step::BIGINT AS step, skill_id FROM plan_reach UNION ALL SELECT instance_id, 0, NULL FROM ids)
SELECT s.instance_id, s.step, any_value(s.skill_id) AS skill_id, count(u.job_id) AS jobs, (sum(count(u.job_id)) OVER (PARTITION BY s.instance_id ORDER BY s.step))::BIGINT AS reachable,
  round(CASE WHEN s.step > 0 THEN quantile_cont(u.pay, 0.5) END - (SELECT quantile_cont(pay, 0.5) FROM unlocked z WHERE z.instance_id = s.instance_id AND z.step = 0), 3)::DOUBLE AS shift_p50
FROM steps s LEFT JOIN unlocked u ON u.instance_id = s.instance_id AND u.step = s.step GROUP BY s.instance_id, s.step"""))
def explained_plans(b):
    packed, _ = _instances(b)
    pay = b.postings.select("job_id", "pay")
    explained = cov.explain_plan(packed, cov.greedy(packed, 3), pay)
    return explained.select("instance_id", F.col("step").cast("long").alias("step"), "skill_id", "jobs", "reachable",
                            F.round("shift_p50", 3).alias("shift_p50"))


PARTS["cost"] = """own AS (SELECT query_id AS instance_id, skill_id FROM profile),
membership AS (SELECT DISTINCT p_brand || '|' || p_type AS skill_id, p_brand AS grp FROM part),
rel AS (SELECT DISTINCT p_brand || '|' || p_type AS a, 'Brand#' || (1 + p_size % 25) || '|' || p_type AS b FROM part),
close AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM rel UNION ALL SELECT b, a FROM rel UNION ALL SELECT x.skill_id, y.skill_id FROM membership x JOIN membership y USING (grp)) WHERE a <> b),
near AS (SELECT DISTINCT instance_id, b AS skill_id FROM own JOIN close ON a = skill_id),
wanted AS (SELECT DISTINCT instance_id, skill_id FROM missing),
cost AS (SELECT instance_id, skill_id, CASE split_part(skill_id, '|', 2) WHEN 'STANDARD' THEN 0.7::DOUBLE WHEN 'ECONOMY' THEN 0.85 WHEN 'PROMO' THEN 1.0 WHEN 'SMALL' THEN 1.15 ELSE 1.0 END
  * CASE WHEN near.skill_id IS NULL THEN 1.0::DOUBLE ELSE 0.7 END AS cost FROM wanted LEFT JOIN near USING (instance_id, skill_id))"""
PARTS["cost"] = PARTS["cost"].replace("ELSE 0.7 END AS cost FROM wanted LEFT JOIN near USING (instance_id, skill_id))",
                                      "ELSE 0.7 END AS cost FROM wanted LEFT JOIN (SELECT *, true AS hit FROM near) near USING (instance_id, skill_id))").replace(
    "near.skill_id IS NULL", "hit IS NULL")


def _costs(b, packed, have):
    part = b.raw("part")
    skill = F.concat_ws("|", "p_brand", "p_type")
    related = part.select(skill.alias("a"), F.concat(
        F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string"), F.lit("|"), "p_type").alias("b")).distinct()
    membership = b.skill_field.select("skill_id", F.col("skill_group").alias("grp"))
    kind = F.col("field")
    levels = b.skill_field.select("skill_id", F.when(kind == "STANDARD", "transversal").when(
        kind == "ECONOMY", "cross-sector").when(kind == "PROMO", "sector-specific").when(
        kind == "SMALL", "occupation-specific").alias("reuse"))
    return cov.effort_costs(cov.wanted_skills(packed), levels, have, cov.either_way(related), membership=membership)


@query("GR-8", sql(BASE + " cost", "SELECT a, b FROM close"))
def close_skill_pairs(b):
    part = b.raw("part")
    related = part.select(F.concat_ws("|", "p_brand", "p_type").alias("a"), F.concat(
        F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string"), F.lit("|"), "p_type").alias("b")).distinct()
    return cov.close_skills(related, b.skill_field.select("skill_id", F.col("skill_group").alias("grp")))


@query("COV-13", sql(BASE + " cost", "SELECT instance_id, skill_id, round(cost, 6)::DOUBLE AS cost FROM cost"))
def effort_costs(b):
    packed, have = _instances(b)
    return _costs(b, packed, have).withColumn("cost", F.round("cost", 6))


@query("COV-8")
def budgeted_plans(b):
    packed, have = _instances(b)
    from talentgrid.session import cut

    packed = cut(cov.merged_pool(packed))
    plans = cov.budgeted(packed, cut(_costs(b, packed, have)), 2.0)
    return plans.select("instance_id", F.array_join("chosen", ",").alias("skills"), F.round("spent", 6).alias("spent"))


@query("COV-9")
def partial_enumeration_plans(b):
    packed, have = _instances(b)
    from talentgrid.session import cut

    packed = cut(cov.merged_pool(packed))
    plans = cov.budgeted_partial(packed, cut(_costs(b, packed, have)), 2.0)
    return plans.select("instance_id", F.array_join("chosen", ",").alias("skills"), F.round("spent", 6).alias("spent"),
                        "F", F.round("G", 6).alias("G"))


@query("COV-11", sql(BASE + " cost", """
, listed AS (SELECT instance_id, skill_id, count(*) AS n FROM missing GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, skill_id) AS i FROM listed JOIN cost USING (instance_id, skill_id)),
walk AS (SELECT instance_id, 0::BIGINT AS i, 0.0::DOUBLE AS spent, ''::VARCHAR AS skills FROM (SELECT DISTINCT instance_id FROM ranked)
  UNION ALL SELECT w.instance_id, r.i, CASE WHEN spent + cost <= 2.0 + 1e-9 THEN spent + cost ELSE spent END,
    CASE WHEN spent + cost <= 2.0 + 1e-9 THEN CASE WHEN skills = '' THEN skill_id ELSE skills || ',' || skill_id END ELSE skills END
  FROM walk w JOIN ranked r ON r.instance_id = w.instance_id AND r.i = w.i + 1)
SELECT instance_id, skills, round(spent, 6)::DOUBLE AS spent FROM walk QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY i DESC) = 1""", recursive=True))
def frequency_budget_plans(b):
    packed, have = _instances(b)
    plans = cov.frequency_within_budget(packed, _costs(b, packed, have), 2.0)
    return plans.select("instance_id", F.array_join("chosen", ",").alias("skills"), F.round("spent", 6).alias("spent"))


COMPARED = BASE + " reach smooth freq reach_value smooth_value freq_value subset"
VALUES = """
, vals AS (SELECT 'greedy_reach' AS method, instance_id, f FROM reach_value UNION ALL SELECT 'greedy_smooth', instance_id, f FROM smooth_value
  UNION ALL SELECT 'frequency', instance_id, f FROM freq_value UNION ALL SELECT 'exhaustive', instance_id, f FROM subset),
opt AS (SELECT instance_id, max(f) AS best FROM vals GROUP BY 1), plain AS (SELECT instance_id, f AS plain FROM freq_value)"""


def _method_values(b):
    # Reach and gains of equal postings add up, so the methods run on distinct ones.
    packed = cov.merged_pool(_instances(b)[0]).persist()
    tables = {
        "greedy_reach": cov.plan_value(packed, cov.greedy(packed, 3)),
        "greedy_smooth": cov.plan_value(packed, cov.greedy(packed, 3, cov.by_smooth)),
        "frequency": cov.plan_value(packed, cov.frequency_plan(packed, 3)),
        "exhaustive": cov.best_subset(packed),
    }
    out = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("method"), "instance_id", "F")
        out = part if out is None else out.unionByName(part)
    return packed, out


@query("COV-15, AGG-20", sql(COMPARED, VALUES + """
SELECT method, count(*) AS instances, round(avg(f), 6)::DOUBLE AS mean_f, round(avg(CASE WHEN best > 0 THEN (best - f) / best::DOUBLE * 100 END), 6)::DOUBLE AS mean_gap,
  round(avg((f = best)::INTEGER), 6)::DOUBLE AS share_optimal, round(avg(f - plain), 6)::DOUBLE AS mean_extra, round(avg((f > plain)::INTEGER), 6)::DOUBLE AS share_better,
  round(quantile_cont(CASE WHEN best > 0 THEN (best - f) / best::DOUBLE * 100 END, 0.95), 6)::DOUBLE AS p95_gap
FROM vals JOIN opt USING (instance_id) JOIN plain USING (instance_id) GROUP BY method"""))
def plan_method_comparison(b):
    _, values = _method_values(b)
    optimum = values.groupBy("instance_id").agg(F.max("F").alias("best"))
    table = cov.compare_methods(values, optimum)
    return table.select("method", "instances", *[
        F.round(c, 6).alias(c) for c in ("mean_f", "mean_gap", "share_optimal", "mean_extra", "share_better", "p95_gap")])


@query("COV-17", sql(COMPARED, VALUES + """
, base AS (SELECT instance_id, count(*) FILTER (100 * base >= need) AS before FROM packed GROUP BY 1),
u AS (SELECT before, plain, best, best - plain AS extra FROM base JOIN plain USING (instance_id) JOIN opt USING (instance_id))
SELECT count(*) AS users, round(avg(before), 6)::DOUBLE AS mean_before, round(avg(plain), 6)::DOUBLE AS mean_frequency, round(avg(best), 6)::DOUBLE AS mean_best,
  round(avg(extra), 6)::DOUBLE AS mean_extra, round(avg((extra > 0)::INTEGER), 6)::DOUBLE AS share_helped, quantile_cont(extra::DOUBLE, 0.25) AS q25,
  quantile_cont(extra::DOUBLE, 0.5) AS median, quantile_cont(extra::DOUBLE, 0.75) AS q75 FROM u"""))
def plan_impact(b):
    packed, values = _method_values(b)
    best = values.groupBy("instance_id").agg(F.max("F").alias("F"))
    table = cov.impact(cov.objectives(packed), values.filter("method = 'frequency'"), best)
    return table.select("users", *[F.round(c, 6).alias(c) for c in (
        "mean_before", "mean_frequency", "mean_best", "mean_extra", "share_helped")], *[
        F.col(c).cast("double").alias(c) for c in ("q25", "median", "q75")])


@query("COV-14, SMP-3")
def pseudo_user_plans(b):
    edges = b.job_skill
    postings = b.postings.withColumn("group_id", F.sha1(F.concat_ws("|", F.lower("company"), "title")))
    split = num.named_split(num.hash_bucket(F.col("group_id"), "17:", 100), num.RANKING_SPLIT)
    users, pool, have = cov.pseudo_users(
        postings, edges, split, lambda c: num.hash_order(c, "up11:"), per_stratum=10)
    packed = cov.pack_pool(pool, have, edges, rec.skill_statistics(edges))
    value = cov.plan_value(packed, cov.greedy(packed, 3))
    return users.join(value, "instance_id").withColumn("G", F.round("G", 6))
