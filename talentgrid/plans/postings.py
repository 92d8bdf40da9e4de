"""Posting cleaning, its audit tables and posting search."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import cleaning
from talentgrid.plans.registry import query, sql


@query("ER-2, FN-6", sql("raw_posting", """
, years AS (SELECT row_no, TRY_CAST(minimumExperience AS DOUBLE) AS a, TRY_CAST(maximumExperience AS DOUBLE) AS b FROM raw_posting)
SELECT row_no, CASE WHEN a > b THEN b ELSE a END AS exp_min, CASE WHEN a > b THEN a ELSE b END AS exp_max,
  CASE WHEN a > b THEN b ELSE a END AS m, CASE WHEN m IS NULL THEN NULL WHEN m <= 1 THEN '0-1' WHEN m < 3 THEN '1-3' WHEN m < 6 THEN '3-6'
    WHEN m < 10 THEN '6-10' ELSE '10+' END AS exp_band FROM years""").replace("AS m, CASE WHEN m IS", "AS m, CASE WHEN m IS"))
def cleaned_experience(b):
    return cleaning.with_experience(b.raw_postings).select(
        "row_no", "exp_min", "exp_max", F.col("exp_min").alias("m"), "exp_band")


SALARY_SELECT = """SELECT jobId, CASE WHEN NOT implausible THEN lo2 END AS salary_min_inr,
  CASE WHEN NOT implausible THEN hi2 END AS salary_max_inr, CASE WHEN NOT implausible THEN (lo2 + hi2) / 2 END AS salary_mid_inr,
  CASE WHEN implausible THEN 'implausible' WHEN usd_paid THEN 'currency_suspect' WHEN lo2 IS NOT NULL THEN 'ok'
    ELSE 'not_disclosed' END AS salary_flag"""


@query("ER-1, ER-3, ER-4, FLT-8, WIN-1", sql("raw_posting first_posting salaried", SALARY_SELECT + r""",
  dup_group_id, len(tags)::BIGINT AS n_tags, strftime(try_strptime(substr(jobId, 1, 6), '%d%m%y'), '%Y-%m-%d') AS posted,
  TRY_CAST(regexp_extract(jobUploaded, '^(\d+) ', 1) AS DOUBLE) AS days_ago,
  CASE WHEN CAST(AggregateRating AS DOUBLE) BETWEEN 0 AND 5 THEN CAST(AggregateRating AS DOUBLE) END AS company_rating
FROM salaried"""))
def cleaned_postings(b):
    return cleaning.clean_postings(b.raw_postings).select(
        "jobId", "salary_min_inr", "salary_max_inr", "salary_mid_inr", "salary_flag", "dup_group_id", "n_tags",
        F.date_format("posted_date", "yyyy-MM-dd").alias("posted"), "days_ago", "company_rating")


@query("ER-1 (convert)", sql("raw_posting first_posting", """
, paid AS (SELECT jobId, currency = 'USD' AS usd, CASE WHEN CAST(minimumSalary AS DOUBLE) > 0 THEN CAST(minimumSalary AS DOUBLE) END AS lo,
    CASE WHEN CAST(maximumSalary AS DOUBLE) > 0 THEN CAST(maximumSalary AS DOUBLE) END AS hi FROM first_posting WHERE trim(title) <> ''),
ranged AS (SELECT jobId, usd, coalesce(lo, hi) * CASE WHEN usd THEN 80.0 ELSE 1.0 END AS a, coalesce(hi, lo) * CASE WHEN usd THEN 80.0 ELSE 1.0 END AS z FROM paid)
SELECT CASE WHEN a IS NULL THEN 'not_disclosed' WHEN least(a, z) < 50000 OR greatest(a, z) > 50000000 THEN 'implausible'
  WHEN usd THEN 'converted_from_usd' ELSE 'ok' END AS salary_flag, count(*) AS rows,
  round(sum(CASE WHEN least(a, z) >= 50000 AND greatest(a, z) <= 50000000 THEN (a + z) / 2 END), 2)::DOUBLE AS mid_total FROM ranged GROUP BY 1"""))
def converted_pay_by_flag(b):
    cleaned = cleaning.clean_postings(b.raw_postings, "convert", 80.0)
    return cleaned.groupBy("salary_flag").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("salary_mid_inr"), 2).alias("mid_total"))


@query("AGG-1", sql("raw_posting first_posting", """
, c AS (SELECT (SELECT count(*) FROM raw_posting) AS raw, count(*) AS ids, count(DISTINCT dup_group_id) AS groups,
  count(*) FILTER (trim(title) <> '') AS titled, count(*) FILTER (trim(title) <> '' AND len(tags) > 0) AS tagged FROM first_posting)
SELECT 'raw' AS step, raw AS rows, NULL::BIGINT AS removed, NULL::BIGINT AS groups FROM c
UNION ALL SELECT 'unique_ids', ids, raw - ids, NULL FROM c UNION ALL SELECT 'near_duplicate_groups', ids, NULL, groups FROM c
UNION ALL SELECT 'titled', titled, ids - titled, NULL FROM c UNION ALL SELECT 'tagged', tagged, titled - tagged, NULL FROM c"""))
def cleaning_step_log(b):
    return cleaning.step_log(b.raw_postings)


RAW_COLUMNS = ["title", "companyName", "tagsAndSkills", "maximumExperience", "location", "currency"]


@query("AGG-2", sql("raw_posting", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing FROM raw_posting"
    for c in RAW_COLUMNS)))
def missing_values(b):
    return cleaning.missing_share(b.raw_postings, RAW_COLUMNS)


DATED = r"""
, dated AS (SELECT CAST(try_strptime(substr(jobId, 1, 6), '%d%m%y') AS DATE) AS posted,
  CASE WHEN jobUploaded = 'Just Now' THEN 0 ELSE TRY_CAST(regexp_extract(jobUploaded, '^(\d+) ', 1) AS INTEGER) END AS age FROM raw_posting),
implied AS (SELECT posted, posted + age AS implied FROM dated),
mode AS (SELECT implied AS scrape FROM implied WHERE implied IS NOT NULL GROUP BY implied ORDER BY count(*) DESC, implied LIMIT 1)"""


@query("AGG-3", sql("raw_posting", DATED + """
SELECT strftime(max(scrape), '%Y-%m-%d') AS scrape_date, count(implied) AS rows_with_age,
  round(avg((abs(datediff('day', scrape, implied)) <= 1)::INTEGER), 4)::DOUBLE AS share_within_1_day,
  round(avg((posted IS NOT NULL)::INTEGER), 4)::DOUBLE AS id_parse_rate, strftime(min(posted), '%Y-%m-%d') AS first_posted,
  strftime(max(posted), '%Y-%m-%d') AS last_posted,
  round(avg((datediff('day', posted, scrape) <= 14)::INTEGER), 4)::DOUBLE AS share_within_14_days FROM implied, mode"""))
def scrape_date_evidence(b):
    return cleaning.scrape_evidence(b.raw_postings)


@query("AGG-3 (weekdays)", sql("raw_posting", DATED + """
SELECT dayname(posted) AS weekday, count(*) AS postings FROM dated WHERE datediff('day', posted, DATE '2001-08-02') <= 30 GROUP BY 1"""))
def recent_weekday_postings(b):
    return cleaning.recent_weekdays(b.raw_postings, "2001-08-02")


@query("AGG-5", sql("raw_posting first_posting salaried", """
SELECT currency, count(*) FILTER (usd) AS usd_rows, count(*) FILTER (usd_paid) AS usd_rows_with_pay,
  count(*) FILTER (swapped) AS swapped, count(*) FILTER (implausible) AS implausible,
  count(*) FILTER (lo2 IS NOT NULL AND NOT implausible) AS disclosed,
  round(avg((lo2 IS NOT NULL AND NOT implausible)::INTEGER), 4)::DOUBLE AS disclosed_share FROM salaried GROUP BY currency"""))
def pay_audit_by_currency(b):
    return cleaning.pay_audit(cleaning.clean_postings(b.raw_postings), "currency")
