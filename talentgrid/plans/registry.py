"""Registration of named queries with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentgrid.sources.bindings import Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

# Shared SQL fragments, each one WITH entry; a query lists the fragments it needs in order.
PARTS = {
    "posting": """posting AS (
  SELECT o.o_orderkey AS job_id, o.o_orderpriority || ' ' || c.c_mktsegment AS title, c.c_name AS company,
    CAST(o.o_orderdate AS DATE) AS posted_date, n.n_name AS state, r.r_name AS region,
    CAST(1 + n.n_regionkey % 3 AS INTEGER) AS tier,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN '0-1' WHEN '2-HIGH' THEN '1-3' WHEN '3-MEDIUM' THEN '3-6'
      WHEN '4-NOT SPECIFIED' THEN '6-10' ELSE '10+' END AS exp_band,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 3
      WHEN '4-NOT SPECIFIED' THEN 6 ELSE 10 END AS exp_min,
    c.c_mktsegment || '|' || o.o_orderpriority AS occupation, c.c_mktsegment AS isco2,
    o.o_totalprice AS pay, o.o_orderstatus <> 'P' AS disclosed, o.o_custkey AS company_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "raw_posting": """raw_posting AS (
  SELECT o_orderkey * 2 + copy AS row_no, strftime(o_orderdate, '%d%m%y') || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS jobId,
    CASE WHEN c_acctbal < 0 THEN ' ' ELSE o_orderpriority || ' ' || c_mktsegment END AS title, c_name AS companyName,
    tagsAndSkills, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'USD' ELSE 'INR' END AS currency,
    CASE WHEN copy = 1 THEN 'Just Now' ELSE datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') || ' Days Ago' END AS jobUploaded,
    CASE WHEN o_orderstatus = 'P' THEN '0' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS minimumSalary,
    CASE WHEN c_acctbal > 5000 THEN '0' WHEN c_mktsegment = 'BUILDING'
      THEN CAST(CAST(floor(floor(o_totalprice) / 2) AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 20000 AS VARCHAR) END AS maximumSalary,
    CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 2 AS VARCHAR) AS minimumExperience,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 2 AS VARCHAR) END AS maximumExperience,
    CAST(CAST(floor(c_acctbal / 1500) AS BIGINT) AS VARCHAR) AS AggregateRating, CAST(o_custkey AS VARCHAR) AS ReviewsCount,
    n_name || CASE WHEN o_orderstatus = 'P' THEN ' / Remote' ELSE '' END AS location
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, string_agg(upper(p_name), ' , ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice) AS tagsAndSkills FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey,
    unnest(CASE WHEN o_orderstatus = 'F' THEN [0, 1] ELSE [0] END) AS u(copy))""",
    "first_posting": """first_posting AS (
  SELECT *, substr(sha1(lower(trim(companyName)) || '|' || trim(regexp_replace(lower(trim(title)), '[^0-9a-z+#]+', ' ', 'g')) || '|' ||
    array_to_string(list_sort(tags), ',')), 1, 16) AS dup_group_id
  FROM (SELECT *, list_distinct(list_transform(string_split(lower(coalesce(tagsAndSkills, '')), ' , '), lambda t: trim(t))) AS tags0,
    CASE WHEN tagsAndSkills IS NULL THEN []::VARCHAR[] ELSE tags0 END AS tags FROM raw_posting
    QUALIFY row_number() OVER (PARTITION BY jobId ORDER BY row_no) = 1))""",
    "salaried": """salaried AS (
  SELECT *, lo1 > hi1 AS swapped, CASE WHEN lo1 > hi1 THEN hi1 ELSE lo1 END AS lo2, CASE WHEN lo1 > hi1 THEN lo1 ELSE hi1 END AS hi2,
    lo2 IS NOT NULL AND (lo2 < 50000 OR hi2 > 50000000) AS implausible
  FROM (SELECT *, currency = 'USD' AS usd, CASE WHEN NOT usd THEN coalesce(lo, hi) END AS lo1, CASE WHEN NOT usd THEN coalesce(hi, lo) END AS hi1,
      usd AND coalesce(lo, hi) IS NOT NULL AS usd_paid
    FROM (SELECT *, CASE WHEN CAST(minimumSalary AS DOUBLE) > 0 THEN CAST(minimumSalary AS DOUBLE) END AS lo,
      CASE WHEN CAST(maximumSalary AS DOUBLE) > 0 THEN CAST(maximumSalary AS DOUBLE) END AS hi FROM first_posting
      WHERE trim(title) <> '')))""",
    "job_skill": """job_skill AS (
  SELECT DISTINCT l_orderkey AS job_id, p_brand || '|' || p_type AS skill_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "job_tag": """job_tag AS (
  SELECT DISTINCT l_orderkey AS job_id, p_name AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "skill_field": """skill_field AS (
  SELECT DISTINCT p_brand || '|' || p_type AS skill_id, p_type AS field, p_brand AS skill_group FROM part)""",
    "demand": """demand AS (
  SELECT occupation, skill_id, count(*) AS postings FROM posting JOIN job_skill USING (job_id) GROUP BY ALL)""",
    "profile": """profile AS (
  SELECT occupation AS query_id, skill_id FROM demand
  QUALIFY row_number() OVER (PARTITION BY occupation ORDER BY postings DESC, skill_id) <= 8)""",
    "requirement": """requirement AS (
  SELECT occupation, skill_id, CASE WHEN rn <= 12 THEN 'essential' ELSE 'optional' END AS relation
  FROM (SELECT *, row_number() OVER (PARTITION BY occupation ORDER BY postings DESC, skill_id) AS rn FROM demand)
  WHERE rn <= 30)""",
    "skill_df": """skill_df AS (SELECT skill_id, count(*) AS df FROM job_skill GROUP BY skill_id)""",
    "n_docs": """n_docs AS (SELECT count(DISTINCT job_id) AS n FROM job_skill)""",
    "skill_stat": """skill_stat AS (
  SELECT skill_id, df, n, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf, 1 / ln(2.0::DOUBLE + df) AS inv FROM skill_df, n_docs)""",
    "doc_norm": """doc_norm AS (SELECT job_id, sqrt(sum(idf * idf)) AS norm FROM job_skill JOIN skill_stat USING (skill_id) GROUP BY job_id)""",
    "query_norm": """query_norm AS (SELECT query_id, sqrt(sum(idf * idf)) AS qnorm FROM profile JOIN skill_stat USING (skill_id) GROUP BY query_id)""",
    "tfidf": """tfidf AS (
  SELECT query_id, job_id, sum(idf * idf) / (min(norm) * min(qnorm)) AS score FROM profile JOIN job_skill USING (skill_id)
  JOIN skill_stat USING (skill_id) JOIN doc_norm USING (job_id) JOIN query_norm USING (query_id) GROUP BY query_id, job_id)""",
    "adar": """adar AS (
  SELECT query_id, job_id, sum(inv) AS score FROM profile JOIN job_skill USING (skill_id) JOIN skill_stat USING (skill_id)
  GROUP BY query_id, job_id)""",
    "skill_weight": """skill_weight AS (
  SELECT skill_id, CAST(round_even(1000 * (ln((1 + n)::DOUBLE / (1 + df)) + 1), 0) AS BIGINT) AS w
  FROM skill_df, n_docs)""",
}


def sql(parts: str, body: str, recursive: bool = False) -> str:
    """WITH clause of the named fragments followed by `body`, which may add its own entries after a leading comma."""
    names = parts.split()
    head = ",\n".join(PARTS[name] for name in names)
    text = body.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if not names:
        return text
    return f"{word} {head}{text if text.startswith(',') else chr(10) + text}"


def query(covers: str, oracle: str | None = None):
    """Register a function of `Bound` under its own name."""

    def register(fn: Callable[[Bound], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Bound(spark, folder))
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
