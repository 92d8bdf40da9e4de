"""Pay ranges, calibration, baselines and disclosure bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.operators import pay as py
from talentgrid.plans.registry import PARTS, query, sql

LEVELS = [["occupation", "tier"], ["occupation"], ["isco2"]]
BASE = "posting paid range margin"
PARTS["paid"] = """paid AS (SELECT *, ln(pay) AS y, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'cal' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('31:' || company), 1, 8))::BIGINT % 100 AS h FROM posting WHERE disclosed))"""
PARTS["range"] = """lv1 AS (SELECT occupation, tier, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.9) AS z FROM paid WHERE split = 'train' GROUP BY ALL HAVING count(*) >= 20),
lv2 AS (SELECT occupation, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.9) AS z FROM paid WHERE split = 'train' GROUP BY ALL HAVING count(*) >= 20),
lv3 AS (SELECT isco2, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.9) AS z FROM paid WHERE split = 'train' GROUP BY ALL HAVING count(*) >= 20),
lv4 AS (SELECT quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.9) AS z FROM paid WHERE split = 'train'),
range AS (SELECT paid.*, coalesce(lv1.a, lv2.a, lv3.a, lv4.a) AS p10, coalesce(lv1.m, lv2.m, lv3.m, lv4.m) AS p50, coalesce(lv1.z, lv2.z, lv3.z, lv4.z) AS p90
  FROM paid LEFT JOIN lv1 ON lv1.occupation = paid.occupation AND lv1.tier = paid.tier LEFT JOIN lv2 ON lv2.occupation = paid.occupation LEFT JOIN lv3 ON lv3.isco2 = paid.isco2, lv4)"""
PARTS["margin"] = """cal AS (SELECT greatest(p10 - y, y - p90) AS s, row_number() OVER (ORDER BY greatest(p10 - y, y - p90)) - 1 AS i, count(*) OVER () AS n FROM range WHERE split = 'cal'),
margin AS (SELECT s AS margin, n FROM cal WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.8::DOUBLE) / n) * (n - 1)))"""


def _paid(b):
    bucket = num.hash_bucket(F.col("company"), "31:", 100)
    return b.postings.filter("disclosed").withColumns({
        "y": F.log("pay"), "split": num.named_split(bucket, num.PAY_SPLIT)})


def _ranged(b):
    paid = _paid(b)
    return paid, py.predict_range(paid, paid.filter("split = 'train'"), LEVELS)


def _tested(b):
    _, ranged = _ranged(b)
    margin = py.conformal_margin(ranged.filter("split = 'cal'")).select("margin").scalar()
    return ranged.filter("split = 'test'").withColumn("margin", margin)


@query("EV-8", sql("posting paid range", """
SELECT job_id, split, round(p10, 6)::DOUBLE AS p10, round(p50, 6)::DOUBLE AS p50, round(p90, 6)::DOUBLE AS p90 FROM range"""))
def pay_ranges(b):
    return _ranged(b)[1].select("job_id", "split", *[F.round(q, 6).alias(q) for q in py.QUANTILES])


@query("EV-9", sql(BASE, "SELECT round(margin, 6)::DOUBLE AS margin, n AS n_values FROM margin"))
def pay_conformal_margin(b):
    return py.conformal_margin(_ranged(b)[1].filter("split = 'cal'")).select(F.round("margin", 6).alias("margin"), "n_values")


METRICS = """count(*) AS n, round(avg(abs(exp(p50) - exp(y))), 3)::DOUBLE AS mae, round(avg((y BETWEEN p10 AND p90)::INTEGER), 6)::DOUBLE AS coverage_raw,
  round(avg((y >= p10 - margin AND y <= p90 + margin)::INTEGER), 6)::DOUBLE AS coverage_calibrated, round(quantile_cont(abs(exp(p50) - exp(y)) / exp(y) * 100, 0.5), 5)::DOUBLE AS mdape_pct,
  round(quantile_cont(exp(p90 + margin) - exp(p10 - margin), 0.5), 3)::DOUBLE AS median_width, round(quantile_cont(exp(p90 + margin) / exp(p10 - margin), 0.5), 5)::DOUBLE AS median_width_ratio"""
ROUNDS = {"mae": 3, "coverage_raw": 6, "coverage_calibrated": 6, "mdape_pct": 5, "median_width": 3, "median_width_ratio": 5}


@query("EV-10", sql(BASE, f"SELECT {METRICS} FROM range, margin WHERE split = 'test'"))
def pay_interval_quality(b):
    return py.interval_quality(_tested(b)).select("n", *[F.round(c, d).alias(c) for c, d in ROUNDS.items()])


@query("EV-10 (groups)", sql(BASE, f"SELECT exp_band, {METRICS} FROM range, margin WHERE split = 'test' GROUP BY exp_band HAVING count(*) >= 50"))
def pay_interval_quality_by_band(b):
    return py.interval_quality(_tested(b), ["exp_band"], min_rows=50).select("exp_band", "n", *[F.round(c, d).alias(c) for c, d in ROUNDS.items()])


@query("EV-11", sql("posting paid range", """
SELECT round(avg(greatest(0.1 * (y - p10), -0.9 * (y - p10))), 6)::DOUBLE AS p10, round(avg(greatest(0.5 * (y - p50), -0.5 * (y - p50))), 6)::DOUBLE AS p50,
  round(avg(greatest(0.9 * (y - p90), -0.1 * (y - p90))), 6)::DOUBLE AS p90 FROM range WHERE split = 'test'"""))
def pay_pinball_loss(b):
    return py.pinball_loss(_ranged(b)[1].filter("split = 'test'")).select(*[F.round(q, 6).alias(q) for q in py.QUANTILES])


@query("AGG-10", sql("posting paid", """
, a AS (SELECT isco2, tier, quantile_cont(y, 0.5) AS m FROM paid WHERE split = 'train' GROUP BY ALL), c AS (SELECT isco2, quantile_cont(y, 0.5) AS m FROM paid WHERE split = 'train' GROUP BY ALL),
g AS (SELECT quantile_cont(y, 0.5) AS m FROM paid WHERE split = 'train')
SELECT job_id, round(coalesce(a.m, c.m, g.m), 6)::DOUBLE AS baseline FROM paid LEFT JOIN a ON a.isco2 = paid.isco2 AND a.tier = paid.tier LEFT JOIN c ON c.isco2 = paid.isco2, g WHERE split = 'test'"""))
def pay_baseline(b):
    paid = _paid(b)
    rows = py.backoff_median(paid.filter("split = 'test'"), paid.filter("split = 'train'"), ["isco2", "tier"], ["isco2"])
    return rows.select("job_id", F.round("baseline", 6).alias("baseline"))


@query("AGG-11", sql("posting paid", """
SELECT occupation, tier, count(*) AS n_support FROM paid WHERE split <> 'test' GROUP BY occupation, tier UNION ALL SELECT occupation, NULL, count(*) FROM paid WHERE split <> 'test' GROUP BY occupation"""))
def pay_support(b):
    return py.support_counts(_paid(b).filter("split <> 'test'"), "occupation", "tier")


@query("EV-31", sql("posting paid range", """
, req AS (SELECT DISTINCT occupation AS code, CASE WHEN isco2 = 'BUILDING' THEN NULL ELSE tier END AS tier, isco2 FROM posting)
SELECT code, req.tier, req.isco2, round_even(exp(coalesce(lv1.a, lv2.a, lv4.a)) / 1000, 0)::DOUBLE * 1000 AS p10, round_even(exp(coalesce(lv1.m, lv2.m, lv4.m)) / 1000, 0)::DOUBLE * 1000 AS p50,
  round_even(exp(coalesce(lv1.z, lv2.z, lv4.z)) / 1000, 0)::DOUBLE * 1000 AS p90, count(paid.job_id) AS n_support, count(paid.job_id) >= 20 AS sufficient
FROM req LEFT JOIN lv1 ON lv1.occupation = code AND lv1.tier = req.tier LEFT JOIN lv2 ON lv2.occupation = code CROSS JOIN lv4
LEFT JOIN paid ON paid.occupation = code AND (req.tier IS NULL OR paid.tier = req.tier) AND split <> 'test' GROUP BY ALL"""))
def pay_requests(b):
    paid = _paid(b)
    tier = F.when(F.col("isco2") != "BUILDING", F.col("tier"))
    requests = b.postings.select(F.col("occupation").alias("code"), tier.alias("tier"), "isco2").distinct()
    train = paid.filter("split = 'train'").withColumnRenamed("occupation", "code")
    ranges = py.predict_range(requests, train, [["code", "tier"], ["code"]])
    support = py.support_counts(paid.filter("split <> 'test'").withColumnRenamed("occupation", "code"), "code", "tier")
    return py.pay_answers(requests, ranges, support)


@query("AGG-23", sql("posting", """
SELECT state, count(*) FILTER (disclosed) AS n_support, round_even(quantile_cont(pay * 0.9, 0.5) / 1000, 0)::DOUBLE * 1000 AS p10, round_even(quantile_cont(pay, 0.5) / 1000, 0)::DOUBLE * 1000 AS p50,
  round_even(quantile_cont(pay * 1.1, 0.5) / 1000, 0)::DOUBLE * 1000 AS p90, count(*) FILTER (disclosed) >= 20 AS sufficient FROM posting GROUP BY state"""))
def pay_summary_by_state(b):
    rows = b.postings.withColumns({"p10": F.col("pay") * 0.9, "p50": F.col("pay"), "p90": F.col("pay") * 1.1})
    return py.pay_summary(rows, ["state"])


@query("AGG-9", sql("posting", """
SELECT state, count(*) AS rows, round(avg(disclosed::INTEGER), 6)::DOUBLE AS rate FROM posting GROUP BY state HAVING count(*) >= 200"""))
def disclosure_rates(b):
    return py.disclosure_rates(b.postings, "state", "disclosed").withColumn("rate", F.round("rate", 6))


@query("EV-13", sql("posting", """
, cells AS (SELECT state, disclosed, count(*) AS n FROM posting GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY state) * sum(n) OVER (PARTITION BY disclosed) / sum(n) OVER ()::DOUBLE AS expected, sum(n) OVER () AS total FROM cells)
SELECT round(sum((n - expected) ** 2 / expected), 6)::DOUBLE AS chi2, count(DISTINCT state) - 1 AS dof, round(sqrt(sum((n - expected) ** 2 / expected) / max(total)), 6)::DOUBLE AS cramers_v FROM e"""))
def disclosure_association(b):
    return py.association(b.postings, "state", "disclosed").select(
        F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


@query("EV-13 (p value)")
def disclosure_chi_square_test(b):
    return py.chi_square_p(b.postings.select("state", "disclosed"), "state", "disclosed")


@query("EV-14", sql("posting", """
SELECT round(avg(pay) FILTER (disclosed), 3)::DOUBLE AS mean_true, round(avg(pay) FILTER (NOT disclosed), 3)::DOUBLE AS mean_false,
  round((avg(pay) FILTER (disclosed) - avg(pay) FILTER (NOT disclosed)) / sqrt((var_samp(pay) FILTER (disclosed) + var_samp(pay) FILTER (NOT disclosed)) / 2), 6)::DOUBLE AS smd FROM posting"""))
def disclosure_mean_difference(b):
    return py.mean_difference(b.postings, "pay", "disclosed").select(
        F.round("mean_true", 3).alias("mean_true"), F.round("mean_false", 3).alias("mean_false"), F.round("smd", 6).alias("smd"))


@query("WIN-10, EV-14", sql("posting", """
, c AS (SELECT pay, count(*) FILTER (disclosed) AS y, count(*) FILTER (NOT disclosed) AS o FROM posting GROUP BY pay),
f AS (SELECT sum(y) OVER (ORDER BY pay) / sum(y) OVER ()::DOUBLE AS fy, sum(o) OVER (ORDER BY pay) / sum(o) OVER ()::DOUBLE AS fo FROM c)
SELECT round(max(abs(fy - fo)), 6)::DOUBLE AS ks FROM f"""))
def disclosure_distribution_gap(b):
    return py.ks_statistic(b.postings, "pay", "disclosed").select(F.round("ks", 6).alias("ks"))


@query("EV-15")
def disclosure_propensity_auc(b):
    from talentgrid.session import cut

    rows = b.postings.select("job_id", "company", "isco2", "exp_band", "tier", F.col("exp_min").cast("double").alias("exp_min"), "pay", "disclosed")
    scored = cut(py.disclosure_propensity(rows, ["isco2", "exp_band"], ["tier", "exp_min"], "disclosed", num.hash_bucket(F.col("company"), "f:", 5)))
    return py.auc(scored, "propensity", "disclosed").select(F.round("auc", 3).alias("auc"))


@query("EV-15 (weighted refit)")
def disclosure_propensity_shift(b):
    from talentgrid.session import cut

    bucket = num.hash_bucket(F.col("company"), "31:", 100)
    rows = b.postings.select(
        "job_id", "company", "occupation", "isco2", "exp_band", "tier", F.col("exp_min").cast("double").alias("exp_min"), "disclosed",
        F.when(F.col("disclosed"), F.log("pay")).alias("y"), num.named_split(bucket, num.PAY_SPLIT).alias("split"))
    scored = cut(py.disclosure_propensity(rows, ["isco2", "exp_band"], ["tier", "exp_min"], "disclosed", num.hash_bucket(F.col("company"), "f:", 5)))
    shift = py.propensity_shift(scored, LEVELS)
    return shift.select(*[F.round(c, 1).alias(c) for c in shift.columns[:-1]], "undisclosed")


@query("EV-12")
def pay_feature_vectors(b):
    from pyspark.ml.functions import vector_to_array

    from talentgrid.functions.distributed import item_sets

    rows = b.postings.join(item_sets(b.job_skill, "job_id", "skill_id"), "job_id").withColumn("words", F.split("title", " "))
    vectors = py.pay_features(rows, ["isco2", "exp_band", "state"], ["exp_min", "tier"], ["items", "words"])
    return vectors.select("job_id", F.size(vector_to_array("features")).alias("dims"))
