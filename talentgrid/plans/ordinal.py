"""Ordinal pay bands over one posting line per order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.operators import ordinal as od
from talentgrid.operators.grouping import connected_groups
from talentgrid.plans.registry import PARTS, query, sql
from talentgrid.session import cut

PARTS["lines"] = """lines AS (SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Sr Data Engineer' WHEN 'FURNITURE' THEN 'Machine Learning Lead' WHEN 'MACHINERY' THEN 'BI Developer'
    WHEN 'BUILDING' THEN 'Back Office Typing' ELSE 'Manager' END AS job_desig, replace(p_name, ' ', ', ') || CASE WHEN p_type = 'PROMO' THEN '...' ELSE '' END AS key_skills, r_name AS location,
    CASE o_orderpriority WHEN '1-URGENT' THEN '0-2 yrs' WHEN '2-HIGH' THEN '1-4 yrs' WHEN '3-MEDIUM' THEN ' 3 - 6 yr' WHEN '4-NOT SPECIFIED' THEN '6-10 yrs' ELSE '10-15 yrs' END AS experience,
    CASE WHEN o_totalprice < 80000 THEN '0to3' WHEN o_totalprice < 160000 THEN '3to6' WHEN o_totalprice < 240000 THEN '6to10' WHEN o_totalprice < 320000 THEN '10to15'
      WHEN o_totalprice < 400000 THEN '15to25' ELSE '25to50' END AS salary, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'desc' END AS job_description
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PARTS["prep"] = r"""copies AS (SELECT *, count(*) AS multiplicity FROM lines GROUP BY ALL),
shaped AS (SELECT *, 'analytics:' || substr(sha256(to_json([job_desig, key_skills, location, experience, salary, job_description])), 1, 24) AS row_key,
  list_position(['0to3', '3to6', '6to10', '10to15', '15to25', '25to50'], salary) - 1 AS band, regexp_extract(experience, '(\d+)\s*-\s*(\d+)', 1)::DOUBLE AS exp_min, regexp_extract(experience, '(\d+)\s*-\s*(\d+)', 2)::DOUBLE AS exp_max,
  key_skills LIKE '%...' AS skills_truncated, CASE WHEN skills_truncated THEN [split_part(key_skills, ', ', 1)] ELSE list_sort(list_distinct(string_split(key_skills, ', '))) END AS skills,
  list_sort(list_distinct(string_split(replace(key_skills, '...', ''), ', '))) AS skills_permissive,
  CASE job_desig WHEN 'Sr Data Engineer' THEN 'Data engineer' WHEN 'Machine Learning Lead' THEN 'Data scientist' WHEN 'BI Developer' THEN 'Data analyst' WHEN 'Back Office Typing' THEN 'Operations' ELSE 'Other' END AS role_family,
  job_desig || '|' || key_skills || '|' || location || '|' || experience AS fs, job_desig || '|' || array_to_string(skills, '|') || '|' || location AS ns, false AS quality_flag FROM copies),
prep AS (SELECT *, CASE WHEN h < 6000 THEN 'train' WHEN h < 7500 THEN 'validation' WHEN h < 8500 THEN 'calibration' ELSE 'test' END AS split,
    CAST(least(5, greatest(0, band + ('0x' || substr(sha256('p:' || row_key), 1, 8))::BIGINT % 3 - 1)) AS INTEGER) AS prediction
  FROM (SELECT *, ('0x' || substr(sha256('bands:' || group_id), 1, 8))::BIGINT % 10000 AS h FROM (SELECT *, substr(sha256(min(row_key) OVER (PARTITION BY ns)), 1, 20) AS group_id FROM shaped)))"""
PARTS["radius"] = """radius AS (SELECT e AS radius, n FROM (SELECT abs(band - prediction) AS e, row_number() OVER (ORDER BY abs(band - prediction)) AS i, count(*) OVER () AS n FROM prep WHERE split = 'calibration') WHERE i = ceil((n + 1) * 0.9::DOUBLE)),
sets AS (SELECT prep.*, greatest(0, prediction - radius) AS set_low, least(5, prediction + radius) AS set_high, band BETWEEN greatest(0, prediction - radius) AND least(5, prediction + radius) AS covered,
  least(5, prediction + radius) - greatest(0, prediction - radius) + 1 AS width FROM prep, radius WHERE split = 'test')"""
PREP = "lines prep"


def lines(b):
    priority, segment, pay = F.col("o_orderpriority"), F.col("c_mktsegment"), F.col("o_totalprice")
    joined = (
        b.raw("lineitem").join(b.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(b.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.places, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    band = F.lit("25to50")
    for limit, name in ((400000, "15to25"), (320000, "10to15"), (240000, "6to10"), (160000, "3to6"), (80000, "0to3")):
        band = F.when(pay < limit, name).otherwise(band)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("s_no"),
        F.when(segment == "HOUSEHOLD", "Sr Data Engineer").when(segment == "FURNITURE", "Machine Learning Lead")
        .when(segment == "MACHINERY", "BI Developer").when(segment == "BUILDING", "Back Office Typing").otherwise("Manager").alias("job_desig"),
        F.concat(F.regexp_replace("p_name", " ", ", "), F.when(F.col("p_type") == "PROMO", "...").otherwise("")).alias("key_skills"),
        F.col("region").alias("location"),
        F.when(priority == "1-URGENT", "0-2 yrs").when(priority == "2-HIGH", "1-4 yrs").when(priority == "3-MEDIUM", " 3 - 6 yr")
        .when(priority == "4-NOT SPECIFIED", "6-10 yrs").otherwise("10-15 yrs").alias("experience"),
        band.alias("salary"), F.when(segment != "BUILDING", "desc").alias("job_description"))


def prepared(b):
    return od.prepare_bands(lines(b))


def shaped(b):
    """Prepared rows for queries that need neither group nor split, written once as they read them several times."""
    return cut(od.shape_bands(lines(b)))


def _scored(b):
    shift = num.hash_bucket(F.col("row_key"), "p:", 3) - 1
    return prepared(b).withColumn("prediction", F.least(F.lit(5), F.greatest(F.lit(0), F.col("band") + shift)).cast("int"))


def _covered(scored):
    radius = od.calibration_radius(scored.filter("split = 'calibration'")).select("radius").scalar()
    return od.with_band_sets(scored.filter("split = 'test'"), radius)


@query("ER-21, AGG-16, FN-16, FN-17, FN-18, FN-29, SRC-13", sql(PREP, """
SELECT row_key, band, exp_min, exp_max, multiplicity, array_to_string(skills, '|') AS skills, array_to_string(skills_permissive, '|') AS skills_permissive, skills_truncated, role_family, group_id, split FROM prep"""))
def prepared_bands(b):
    return prepared(b).select(
        "row_key", "band", "exp_min", "exp_max", "multiplicity", F.array_join("skills", "|").alias("skills"),
        F.array_join("skills_permissive", "|").alias("skills_permissive"), "skills_truncated", "role_family", "group_id", "split")


@query("ER-20", """
WITH RECURSIVE r AS (SELECT 'c:' || c_custkey AS row_key, c_nationkey || '|' || c_mktsegment || '|' || floor(c_acctbal / 200)::BIGINT AS a, c_nationkey || '|' || floor(c_acctbal / 20)::BIGINT AS b FROM customer),
e AS (SELECT DISTINCT x.row_key AS s, y.row_key AS d FROM r x JOIN r y ON x.a = y.a OR x.b = y.b),
reach AS (SELECT row_key AS s, row_key AS d FROM r UNION SELECT reach.s, e.d FROM reach JOIN e ON e.s = reach.d)
SELECT s AS row_key, substr(sha256(min(d)), 1, 20) AS group_id FROM reach GROUP BY s""")
def connected_customer_groups(b):
    balance = F.col("c_acctbal")
    rows = b.raw("customer").select(
        F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("row_key"), "c_nationkey", "c_mktsegment",
        F.floor(balance / 200).alias("wide"), F.floor(balance / 20).alias("narrow"))
    return connected_groups(rows, "row_key", [["c_nationkey", "c_mktsegment", "wide"], ["c_nationkey", "narrow"]]).select("row_key", "group_id")


@query("AGG-17", sql(PREP, """
, c AS (SELECT fs, band, count(*) AS n FROM prep GROUP BY ALL), g AS (SELECT fs, count(*) AS bands, sum(n) AS rows, max(n) AS top FROM c GROUP BY fs)
SELECT count(*) FILTER (bands > 1) AS conflicting_groups, (sum(rows) FILTER (bands > 1))::BIGINT AS rows_in_conflict, round(sum(top) / sum(rows)::DOUBLE, 6)::DOUBLE AS agreement_bound FROM g"""))
def label_conflicts(b):
    return od.label_conflicts(shaped(b)).withColumn("agreement_bound", F.round("agreement_bound", 6))


@query("EV-20", sql(PREP, """
SELECT sha256(lower(trim(regexp_replace(job_desig, '\\s+', ' ', 'g'))) || '|' || key_skills || '|' || lower(location) || '|' || trim(experience)) AS feature_signature, count(*) AS n, round(count(*) FILTER (band = 0) / count(*)::DOUBLE, 6)::DOUBLE AS share_0,
  round(count(*) FILTER (band = 5) / count(*)::DOUBLE, 6)::DOUBLE AS share_5 FROM prep GROUP BY 1"""))
def soft_band_targets(b):
    return od.soft_targets(shaped(b)).select("feature_signature", "n", F.round("share_0", 6).alias("share_0"), F.round("share_5", 6).alias("share_5"))


@query("AGG-18", sql(PREP, """
SELECT b::INTEGER AS band, p::INTEGER AS prediction, count(row_key) AS n FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS b), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS p)
LEFT JOIN (SELECT * FROM prep WHERE split = 'test') s ON s.band = b AND s.prediction = p GROUP BY ALL"""))
def band_confusion(b):
    return od.confusion(_scored(b).filter("split = 'test'")).select("band", "prediction", "n")


@query("EV-16", sql(PREP, """
, c AS (SELECT split, band, prediction, count(*) AS n FROM prep GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY split) AS total, abs(band - prediction) AS d FROM c),
rw AS (SELECT split, band AS k, sum(n) AS r FROM c GROUP BY ALL), cl AS (SELECT split, prediction AS k, sum(n) AS q FROM c GROUP BY ALL),
ch AS (SELECT rw.split, sum((rw.k - cl.k) ** 2 * r * q) AS e FROM rw JOIN cl ON cl.split = rw.split GROUP BY rw.split),
f AS (SELECT rw.split, sum(coalesce(2 * n, 0) / (r + coalesce(q, 0))::DOUBLE) / 6 AS f1, avg(coalesce(n, 0) / r::DOUBLE) AS bal FROM rw LEFT JOIN cl USING (split, k) LEFT JOIN c ON c.split = rw.split AND c.band = k AND c.prediction = k GROUP BY rw.split)
SELECT m.split, max(total)::BIGINT AS n, round(1 - sum(d * d * n) / (any_value(e) / max(total)), 6)::DOUBLE AS qwk, round(any_value(f1), 6)::DOUBLE AS macro_f1, round(any_value(bal), 6)::DOUBLE AS balanced_accuracy,
  round(sum(d * n) / max(total)::DOUBLE, 6)::DOUBLE AS mean_band_error, round(sum(n) FILTER (d <= 1) / max(total)::DOUBLE, 6)::DOUBLE AS within_one_band FROM m JOIN ch USING (split) JOIN f USING (split) GROUP BY m.split"""))
def band_fit_metrics(b):
    table = od.band_metrics(_scored(b), ["split"])
    return table.select("split", "n", *[F.round(c, 6).alias(c) for c in ("qwk", "macro_f1", "balanced_accuracy", "mean_band_error", "within_one_band")])


@query("EV-17", sql(PREP + " radius", """
SELECT role_family, (SELECT radius FROM radius)::INTEGER AS radius, count(*) AS n, round(avg(covered::INTEGER), 6)::DOUBLE AS coverage, round(avg(width), 6)::DOUBLE AS set_width FROM sets GROUP BY role_family HAVING count(*) >= 30"""))
def band_set_coverage(b):
    scored = cut(_scored(b))
    radius = od.calibration_radius(scored.filter("split = 'calibration'")).select("radius").scalar()
    return _covered(scored).groupBy("role_family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("covered").cast("double")), 6).alias("coverage"),
        F.round(F.avg("width"), 6).alias("set_width")).filter("n >= 30").withColumn("radius", radius)


@query("EV-18", sql(PREP + " radius", """
, long AS (SELECT 'overall' AS slice, 'all' AS value, * FROM sets UNION ALL SELECT 'role_family', role_family, * FROM sets UNION ALL SELECT 'truncated', skills_truncated::VARCHAR, * FROM sets
  UNION ALL SELECT 'experience', CASE WHEN (exp_min + exp_max) / 2 <= 2 THEN 'up to 2' WHEN (exp_min + exp_max) / 2 <= 5 THEN 'above 2 to 5' WHEN (exp_min + exp_max) / 2 <= 8 THEN 'above 5 to 8' ELSE 'above 8' END, * FROM sets)
SELECT slice, value, count(*) AS rows, count(DISTINCT group_id) AS groups, count(*) >= 30 AND count(DISTINCT group_id) >= 20 AS supported,
  CASE WHEN supported THEN round(avg(covered::INTEGER), 6) END::DOUBLE AS coverage, CASE WHEN supported THEN round(avg(width), 6) END::DOUBLE AS mean_width FROM long GROUP BY slice, value"""))
def band_calibration_audit(b):
    covered = _covered(cut(_scored(b)))
    table = od.calibration_audit(covered, {
        "role_family": F.col("role_family"), "truncated": F.col("skills_truncated"), "experience": od.experience_slice(F.col("exp_mid"))})
    return table.select("slice", "value", "rows", "groups", "supported", F.round("coverage", 6).alias("coverage"), F.round("mean_width", 6).alias("mean_width"))


@query("EV-18 (intervals), SMP-6")
def band_calibration_intervals(b):
    covered = _covered(cut(_scored(b)))
    table = od.calibration_audit(covered, {"role_family": F.col("role_family")}, replicates=500)
    return table.select("slice", "value", F.round("coverage", 4).alias("coverage"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("JN-8, SET-5, EV-27", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT l_orderkey AS k, min(CASE WHEN l_returnflag = 'R' THEN 'F' ELSE o_orderstatus END) AS s, max(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT a.k AS job_id, 'missing on the right' AS problem FROM a LEFT JOIN b USING (k) WHERE b.k IS NULL UNION ALL SELECT k, 'different status' FROM a JOIN b USING (k) WHERE a.s <> b.s UNION ALL SELECT k, 'q out of range' FROM b WHERE q > 49""")
def one_to_one_violations(b):
    left = b.raw("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    lined = b.raw("lineitem").join(b.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    right = lined.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.min(F.when(F.col("l_returnflag") == "R", "F").otherwise(F.col("o_orderstatus"))).alias("status"), F.max("l_quantity").alias("q"))
    return od.validate_one_to_one(left, right, "job_id", ["status"], {"q": range(1, 50)})


@query("EV-22", sql(PREP, """
, it AS (SELECT role_family AS family, row_key, unnest(skills) AS skill FROM prep), n AS (SELECT role_family AS family, count(*) AS n FROM prep GROUP BY 1), s AS (SELECT family, skill, count(*) AS c FROM it GROUP BY ALL),
p AS (SELECT x.family, x.skill AS a, y.skill AS b, count(*) AS count FROM it x JOIN it y ON x.row_key = y.row_key AND x.skill <> y.skill GROUP BY ALL)
SELECT p.family, a AS antecedent, b AS consequent, count, round(count / n::DOUBLE, 6)::DOUBLE AS support, round(count / sa.c::DOUBLE, 6)::DOUBLE AS confidence, round(count * n / (sa.c * sb.c)::DOUBLE, 6)::DOUBLE AS lift
FROM p JOIN n ON n.family = p.family JOIN s sa ON sa.family = p.family AND sa.skill = a JOIN s sb ON sb.family = p.family AND sb.skill = b WHERE count >= greatest(20, floor(0.01::DOUBLE * n))
ORDER BY round(count * n / (sa.c * sb.c)::DOUBLE, 9) DESC, count DESC, p.family, a, b LIMIT 80"""))
def skill_association_rules(b):
    return od.association_rules(shaped(b)).select(
        "family", "antecedent", "consequent", "count", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query("WIN-9", """
WITH t AS (SELECT c_mktsegment AS test, avg(o_totalprice) / 1e7 AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t)
SELECT test, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS p_adjusted FROM r""")
def adjusted_p_values(b):
    tests = b.raw("orders").join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("test")).agg((F.avg("o_totalprice") / 1e7).alias("p"))
    return od.step_up_adjusted(tests, "p").select("test", F.round("p_adjusted", 6).alias("p_adjusted"))


@query("EV-23", """
WITH c AS (SELECT (quality = 1)::INTEGER AS y, n_chars AS chars, len(string_split(text, ' ')) AS words, toxic FROM labels JOIN documents USING (doc_id))
SELECT 'chars' AS feature, round(corr(chars, y), 6)::DOUBLE AS r, count(*) AS n FROM c UNION ALL SELECT 'words', round(corr(words, y), 6)::DOUBLE, count(*) FROM c UNION ALL SELECT 'toxic', round(corr(toxic, y), 6)::DOUBLE, count(*) FROM c""")
def cohort_correlations(b):
    return od.point_biserial(_cohort(b), ["chars", "words", "toxic"], "y").select("feature", F.round("r", 6).alias("r"), "n")


def _cohort(b):
    return b.raw("labels").join(b.raw("documents"), "doc_id").select(
        "doc_id", F.col("source").alias("group_id"), (F.col("quality") == 1).cast("int").alias("y"), F.col("n_chars").alias("chars"),
        F.size(F.split("text", " ")).alias("words"), "toxic")


@query("EV-23 (models)")
def cohort_model_auc(b):
    from talentgrid.operators.pay import auc
    cohort = _cohort(b)
    fold = num.hash_bucket(F.col("group_id"), "fold:", 5)
    out = None
    for kind in ("logistic", "tree"):
        scored = cut(od.cohort_models(cohort, ["chars", "words", "toxic"], "y", fold, kind=kind).withColumn("yes", F.col("y") == 1))
        row = auc(scored, "score", "yes").select(F.lit(kind).alias("model"), F.round("auc", 3).alias("auc"))
        out = row if out is None else out.unionByName(row)
    return out


PAID = """WITH o AS (SELECT o_orderpriority AS title, o_totalprice AS pay, o_custkey AS company, ('0x' || substr(sha256('31:' || o_custkey), 1, 8))::BIGINT % 100 < 70 AS train FROM orders)"""


def _paid(b):
    return b.raw("orders").select(
        F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("pay"), F.col("o_custkey").alias("company"),
        (num.hash_bucket(F.col("o_custkey"), "31:", 100) < 70).alias("train"), F.substring("o_orderpriority", 1, 1).cast("double").alias("experience"),
        (F.col("o_orderkey") % 3 + 1).cast("double").alias("jobs"))


@query("EV-24", PAID + """, m AS (SELECT title, quantile_cont(pay, 0.5) AS m FROM o WHERE train GROUP BY 1)
SELECT round(avg(abs(pay - m)), 3)::DOUBLE AS mae, count(*) AS rows FROM o JOIN m USING (title) WHERE NOT train""")
def company_pay_baseline(b):
    paid = _paid(b)
    return od.company_baseline(paid.filter("train"), paid.filter("NOT train")).withColumn("mae", F.round("mae", 3))


@query("EV-24 (variance)", PAID + """, g AS (SELECT company, count(*) AS n, avg(ln(pay)) AS m, var_pop(ln(pay)) AS v FROM o GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS between, sum(n * v) AS within FROM g),
u AS (SELECT *, within / (nn - k) AS msw, greatest((between / (k - 1) - within / (nn - k)) / ((nn - n2 / nn::DOUBLE) / (k - 1)), 0) AS vb FROM t)
SELECT k AS groups, nn::BIGINT AS rows, round(vb / (vb + msw), 6)::DOUBLE AS icc FROM u""")
def company_pay_variance(b):
    return od.variance_components(_paid(b).withColumn("y", F.log("pay")), "y", "company").withColumn("icc", F.round("icc", 6))


@query("EV-24 (ranks)", """
WITH t AS (SELECT c_nationkey, avg(o_totalprice) AS a, round(avg(c_acctbal), -3) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM t)
SELECT round(corr(ra, rb), 6)::DOUBLE AS rho, count(*) AS n FROM r""")
def pay_rank_correlation(b):
    rows = b.raw("orders").join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.avg("o_totalprice").alias("a"), F.round(F.avg("c_acctbal"), -3).alias("b"))
    return od.spearman(rows, "a", "b").withColumn("rho", F.round("rho", 6))


@query("EV-24 (weighted fit)")
def weighted_pay_fit(b):
    paid = _paid(b)
    return od.weighted_pay_fit(paid.filter("train"), paid.filter("NOT train"), "jobs").select(F.round("mae", 1).alias("mae"))


@query("EV-26", """
SELECT round(sum(n * abs(p - y)) / sum(n), 6)::DOUBLE AS ece FROM (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM (SELECT l_discount * 10 AS p, (l_tax > 0.04)::INTEGER AS y FROM lineitem) GROUP BY 1)""")
def calibration_error(b):
    rows = b.raw("lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_tax") > 0.04).cast("int").alias("y"))
    return od.calibration_error(rows).select(F.round("ece", 6).alias("ece"))


@query("EV-26 (temperature)", """
WITH g AS (SELECT i, exp(ln(0.01) + (ln(100) - ln(0.01)) * i / 119) AS t FROM unnest(generate_series(0, 119)) AS u(i)), r AS (SELECT (l_quantity - 25) / 5 AS logit, (l_quantity + 400 * l_tax > 42)::INTEGER AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT round(t, 6)::DOUBLE AS temperature, round(sum(n * (greatest(logit / t, 0) - logit / t * y + ln(1 + exp(-abs(logit / t))))) / sum(n), 6)::DOUBLE AS nll FROM g, r GROUP BY t ORDER BY sum(n * (greatest(logit / t, 0) - logit / t * y + ln(1 + exp(-abs(logit / t))))), t LIMIT 1""")
def fitted_temperature(b):
    rows = b.raw("lineitem").select(
        ((F.col("l_quantity") - 25) / 5).alias("logit"), (F.col("l_quantity") + 400 * F.col("l_tax") > 42).cast("int").alias("y"))
    return od.best_temperature(rows).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("EV-19, EV-32")
def band_classifier_metrics(b):
    rows = cut(prepared(b))
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    fitted = od.band_metrics(od.predict_bands(od.band_classifier(train), valid)).withColumns({"model": F.lit("words"), "baseline": F.lit(False)})
    constant = valid.withColumn("prediction", od.majority_band(train).scalar())
    plain = od.band_metrics(constant).withColumns({"model": F.lit("majority"), "baseline": F.lit(True)})
    table = cut(fitted.unionByName(plain))
    best = od.champion(table).select("model", F.lit(True).alias("champion"))
    return table.join(best, "model", "left").select("model", "n", F.round("qwk", 2).alias("qwk"), F.coalesce("champion", F.lit(False)).alias("champion"))


@query("EV-21")
def token_variant_errors(b):
    rows = cut(prepared(b))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    a = cut(od.predict_bands(od.band_classifier(train), test))
    z = cut(od.predict_bands(od.band_classifier(train, "skills_permissive"), test))
    return od.paired_errors(a, z, 500).select("groups", F.round("delta", 2).alias("delta"))


@query("EV-21 (rows)", sql(PREP, "SELECT count(*) FILTER (skills <> skills_permissive) AS changed, count(*) AS rows FROM prep"))
def changed_token_rows(b):
    return od.changed_rows(shaped(b))


@query("EV-25")
def threshold_slopes(b):
    rows = cut(prepared(b).filter("split = 'train'").withColumn("skill_count", F.size("skills")))
    return od.threshold_slopes(rows, ["exp_mid", "skill_count"]).select("threshold", "feature", F.round("slope", 2).alias("slope"), F.round("se", 2).alias("se"))


@query("EV-25 (contrasts)")
def threshold_slope_tests(b):
    rows = cut(prepared(b).filter("split = 'train'").withColumn("skill_count", F.size("skills")))
    tests = od.slope_contrasts(rows, ["exp_mid", "skill_count"])
    return tests.select("feature", F.round("statistic", 3).alias("statistic"), "df", F.round("p_value", 4).alias("p_value"), F.round("p_fdr", 4).alias("p_fdr"), "status")


@query("EV-23 (odds ratios)")
def cohort_odds_ratios(b):
    ratios = od.odds_ratios(_cohort(b), ["chars", "words", "toxic"], "y")
    return b.spark.createDataFrame(ratios, "feature string, odds_ratio double").withColumn("odds_ratio", F.round("odds_ratio", 2))


REQUESTS = """, req AS (SELECT 'r' || row_number() OVER (ORDER BY role_family, x) AS id0, role_family AS family, x::DOUBLE AS experience, role_family || ':' || x AS request_id FROM (SELECT DISTINCT role_family FROM prep UNION ALL SELECT 'All'), (SELECT unnest([0, 3, 7]) AS x)),
pool AS (SELECT request_id, row_key, band, skills FROM req JOIN prep ON (family = 'All' OR family = role_family) AND exp_min <= req.experience AND exp_max >= req.experience)"""


def _requests(rows):
    families = rows.select(F.col("role_family").alias("family")).distinct().unionByName(
        rows.sparkSession.createDataFrame([("All",)], "family string"))
    return families.withColumn("x", F.explode(F.array(F.lit(0), F.lit(3), F.lit(7)))).select(
        F.concat_ws(":", "family", "x").alias("request_id"), "family", F.col("x").cast("double").alias("experience"))


@query("JN-7, FLT-3", sql(PREP, REQUESTS + " SELECT request_id, count(*) AS support, round(avg(band), 6)::DOUBLE AS mean_band FROM pool GROUP BY 1"))
def scenario_pools(b):
    rows = shaped(b)
    return od.scenario_pool(_requests(rows), rows).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("support"), F.round(F.avg("band"), 6).alias("mean_band"))


@query("AGG-21", sql(PREP, REQUESTS + """, own AS (SELECT request_id, s AS skill FROM req, (SELECT unnest(['small', 'ring', 'nothing']) AS s)), seen AS (SELECT DISTINCT request_id, unnest(skills) AS skill FROM pool)
SELECT request_id, count(*) AS submitted, count(seen.skill) AS observed, round(count(seen.skill) / count(*)::DOUBLE, 6)::DOUBLE AS fraction FROM own LEFT JOIN seen USING (request_id, skill) GROUP BY request_id""".replace("count(seen.skill)", "count(hit)").replace("LEFT JOIN seen USING", "LEFT JOIN (SELECT *, true AS hit FROM seen) USING")))
def scenario_vocabulary(b):
    rows = shaped(b)
    requests = _requests(rows)
    owned = requests.select("request_id", F.explode(F.array(F.lit("small"), F.lit("ring"), F.lit("nothing"))).alias("skill"))
    return od.vocabulary_evidence(owned, od.scenario_pool(requests, rows)).withColumn("fraction", F.round("fraction", 6))


@query("EV-32", sql(PREP, REQUESTS + """
SELECT req.request_id, count(p.row_key) AS support, count(p.row_key) >= 20 AND family NOT IN ('All', 'Other') AS available, CASE WHEN available THEN 2 END::INTEGER AS prediction,
  CASE WHEN available THEN 1 END::INTEGER AS set_low, CASE WHEN available THEN 3 END::INTEGER AS set_high FROM req LEFT JOIN pool p ON p.request_id = req.request_id GROUP BY req.request_id, family"""))
def scenario_band_sets(b):
    rows = shaped(b)
    requests = _requests(rows)
    fixed = requests.select("request_id", F.lit(2).alias("prediction"))
    return od.band_answers(requests, rows, fixed, F.lit(1)).select("request_id", "support", "available", "prediction", "set_low", "set_high")


@query("COV-18, AGG-19")
def scenario_plan_roll_up(b):
    from talentgrid.operators import coverage as cov
    rows = shaped(b)
    requests = cut(_requests(rows))
    pool = od.scenario_pool(requests, rows).select(F.col("request_id").alias("instance_id"), F.col("row_key").alias("job_id"), F.lit(1).cast("long").alias("value"))
    edges = rows.select(F.col("row_key").alias("job_id"), F.explode("skills").alias("skill_id"))
    have = requests.select(F.col("request_id").alias("instance_id"), F.lit("small").alias("skill_id"))
    weights = edges.select("skill_id").distinct().withColumn("w", F.lit(1).cast("long"))
    packed = cov.pack_pool(pool, have, edges, weights).persist()
    plans = {"frequency": cov.frequency_plan(packed, 3), "greedy_reach": cov.greedy(packed, 3), "greedy_smooth": cov.greedy(packed, 3, cov.by_smooth)}
    values = None
    for name, plan in plans.items():
        part = cov.plan_value(packed, plan).select(F.lit(name).alias("method"), F.col("instance_id").alias("request_id"), "F", "G")
        values = part if values is None else values.unionByName(part)
    portfolio = values.groupBy("request_id").agg(F.max(F.struct("F", "G")).alias("b")).select(
        F.lit("portfolio").alias("method"), "request_id", "b.F", "b.G")
    return od.method_roll_up(cut(values.unionByName(portfolio)))


@query("SRC-14, FN-28", sql(PREP, """
SELECT row_key, group_id, split, band, exp_min, exp_max, (exp_min + exp_max) / 2 AS exp_mid, len(skills) AS skill_count, 0 AS statistics, 0 AS modelling, skills_truncated::INTEGER AS skills_truncated, 0 AS quality_flag, multiplicity FROM prep"""))
def exchange_rows(b):
    return od.exchange_rows(prepared(b))


@query("SRC-13, EV-27", sql(PREP, """
SELECT 'prepared_rows' AS measure, count(*) AS n FROM prep UNION ALL SELECT 'copies_removed', sum(multiplicity)::BIGINT - count(*) FROM prep UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM prep
UNION ALL SELECT 'skills_truncated', count(*) FILTER (skills_truncated) FROM prep UNION ALL SELECT 'quality_flagged', 0 UNION ALL SELECT 'rows_' || split, count(*) FROM prep GROUP BY split"""))
def partition_audit(b):
    return od.partition_audit(prepared(b))
