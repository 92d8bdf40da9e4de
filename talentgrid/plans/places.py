"""Gazetteer, token resolution and geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import geography as geo
from talentgrid.plans.registry import PARTS, query, sql

PARTS["gaz"] = """place AS (
  SELECT s_name AS name, 'S' || s_suppkey AS alternate, n_name AS state, greatest(CAST(floor(s_acctbal * 20) AS BIGINT), 0) AS population,
    s_suppkey / 100.0::DOUBLE AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey),
gaz AS (SELECT key, name AS place, state, population, lat FROM (
    SELECT replace(lower(name), '#', ' ') AS key, * FROM place UNION ALL
    SELECT lower(alternate), * FROM place WHERE population >= 50000)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY population DESC, name, state) = 1)"""

PARTS["located"] = """located AS (
  SELECT c_custkey AS job_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Supplier#' || lpad(CAST(c_nationkey * 3 AS VARCHAR), 9, '0') || ' / Dubai'
    WHEN 'FURNITURE' THEN 'S' || c_nationkey || ', ' || n_name || ';' || n_name WHEN 'MACHINERY' THEN 'Suplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0')
    WHEN 'BUILDING' THEN 'Remote' ELSE 'Old Town ' || c_custkey || ' / Singapore' END AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PARTS["aliased"] = """alias AS (
  SELECT 'old town ' || c_custkey AS key, 'City ' || c_nationkey AS city, 'supplier ' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS lookup FROM customer
    WHERE c_mktsegment = 'AUTOMOBILE' AND c_custkey % 3 > 0
  UNION ALL SELECT 's' || n_nationkey, 'Harbour ' || n_nationkey, 'harbour ' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'supplier ' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0'), 'City ' || (n_nationkey * 3), 'supplier ' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0')
    FROM nation WHERE n_nationkey % 2 = 0)"""

PARTS["resolved"] = """token AS (
  SELECT job_id, i - 1 AS rank, trim(t[i]) AS token FROM (SELECT job_id, string_split_regex(location, '[,/;|]') AS t FROM located WHERE location <> 'Remote'),
    unnest(generate_series(1, len(t))) AS u(i)),
asked AS (SELECT token, replace(lower(token), '#', ' ') AS k, alias.city AS alias_city FROM (SELECT DISTINCT token FROM token) LEFT JOIN alias ON alias.key = replace(lower(token), '#', ' ')),
hit AS (SELECT a.*, coalesce(x.place, y.place) AS place, coalesce(x.state, y.state) AS state, coalesce(x.population, y.population) AS population FROM asked a
  LEFT JOIN alias ON alias.key = a.k LEFT JOIN gaz x ON x.key = CASE WHEN a.alias_city IS NULL THEN a.k ELSE alias.lookup END LEFT JOIN gaz y ON y.key = lower(a.alias_city)),
chosen AS (SELECT token, alias_city, CASE WHEN token IN ('Dubai', 'Singapore') THEN 'foreign' WHEN h.place IS NOT NULL AND alias_city IS NOT NULL THEN 'alias'
    WHEN h.place IS NOT NULL THEN 'exact' WHEN n_name IS NOT NULL THEN 'state_only' WHEN f.key IS NOT NULL THEN 'fuzzy' END AS matched_by,
    CASE WHEN token NOT IN ('Dubai', 'Singapore') THEN coalesce(h.place, CASE WHEN n_name IS NULL THEN f.place END) END AS place,
    coalesce(h.state, n_name, f.state) AS state, coalesce(h.population, CASE WHEN n_name IS NULL THEN f.population END) AS population
  FROM hit h LEFT JOIN nation ON n_name = token
  LEFT JOIN gaz f ON h.place IS NULL AND f.population >= 20000 AND (k LIKE 'suplier %' OR alias_city IS NOT NULL) AND f.key = replace(k, 'suplier', 'supplier')),
resolved AS (SELECT token, matched_by, CASE WHEN place IS NOT NULL THEN coalesce(alias_city, city, place) END AS city, state, population
  FROM chosen LEFT JOIN (SELECT key, city FROM alias) u ON u.key = replace(lower(place), '#', ' '))"""

PARTS["job_place"] = """tiering AS (SELECT coalesce(alias.city, s_name) AS city, 1 + s_nationkey % 2 AS tier, CASE WHEN s_acctbal > 5000 THEN n_name ELSE 'NATION_0' END AS tier_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN alias ON alias.key = replace(lower(s_name), '#', ' ')),
job_place AS (SELECT job_id, rank, city, state, matched_by, population, CAST(CASE WHEN city IS NULL THEN NULL WHEN tier IS NULL OR tier_state <> state THEN 3 ELSE tier END AS INTEGER) AS tier
  FROM (SELECT * FROM token JOIN resolved USING (token) WHERE matched_by IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY job_id, city, state, matched_by ORDER BY rank) = 1) LEFT JOIN tiering USING (city)),
coded AS (SELECT l.job_id, CASE WHEN location = 'Remote' THEN 'remote' ELSE 'onsite' END AS work_mode,
    coalesce(bool_or(matched_by = 'foreign'), false) AS has_foreign_location,
    arg_min(city, (city IS NULL)::INTEGER * 1000 + rank) FILTER (matched_by <> 'foreign' AND city IS NOT NULL) AS primary_city,
    coalesce(arg_min(state, rank) FILTER (matched_by <> 'foreign' AND city IS NOT NULL), arg_min(state, rank) FILTER (matched_by <> 'foreign')) AS primary_state,
    arg_min(tier, rank) FILTER (matched_by <> 'foreign' AND city IS NOT NULL) AS primary_tier,
    count(city) FILTER (matched_by <> 'foreign') AS n_cities, count(matched_by) FILTER (matched_by <> 'foreign') AS n_places
  FROM located l LEFT JOIN job_place USING (job_id) GROUP BY ALL)"""


def _tables(b):
    supplier = b.raw("supplier").join(b.places, F.col("s_nationkey") == F.col("n_nationkey"))
    places = supplier.select(
        F.col("s_name").alias("name"), F.col("s_name").alias("ascii"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("alternates"), "state",
        F.greatest(F.floor(F.col("s_acctbal") * 20), F.lit(0)).alias("population"),
        (F.col("s_suppkey") / 100).alias("lat"), F.lit(0.0).alias("lon"))
    tiers = supplier.select(
        F.col("s_name").alias("city"), (1 + F.col("s_nationkey") % 2).alias("tier"),
        F.when(F.col("s_acctbal") > 5000, F.col("state")).otherwise("NATION_0").alias("tier_state"))
    segment = F.col("c_mktsegment")
    number = F.col("c_custkey").cast("string")
    jobs = b.raw("customer").join(b.places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("job_id"),
        F.when(segment == "HOUSEHOLD", F.concat(
            F.lit("Supplier#"), F.lpad((F.col("c_nationkey") * 3).cast("string"), 9, "0"), F.lit(" / Dubai")))
        .when(segment == "FURNITURE", F.concat(F.lit("S"), F.col("c_nationkey").cast("string"), F.lit(", "), "state", F.lit(";"), "state"))
        .when(segment == "MACHINERY", F.concat(F.lit("Suplier#"), F.lpad((F.col("c_custkey") % 100).cast("string"), 9, "0")))
        .when(segment == "BUILDING", "Remote")
        .otherwise(F.concat(F.lit("Old Town "), number, F.lit(" / Singapore"))).alias("location"))
    supplier_name = lambda n: F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    nation = F.col("n_nationkey")
    towns = b.raw("customer").filter((segment == "AUTOMOBILE") & (F.col("c_custkey") % 3 > 0)).select(
        F.concat(F.lit("Old Town "), number).alias("alias"), F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"),
        supplier_name(F.col("c_nationkey")).alias("lookup"))
    short = b.raw("nation").filter(nation % 5 == 0).select(
        F.concat(F.lit("S"), nation.cast("string")), F.concat(F.lit("Harbour "), nation.cast("string")), F.lit(""))
    renamed = b.raw("nation").filter(nation % 2 == 0).select(
        supplier_name(nation * 3), F.concat(F.lit("City "), (nation * 3).cast("string")), supplier_name(nation * 3))
    aliases = towns.union(short).union(renamed)
    return jobs, geo.gazetteer(places), aliases, b.places.select("state"), tiers


@query("ER-5, SRC-4", sql("gaz", "SELECT key, place, state, population, round(lat, 4)::DOUBLE AS lat FROM gaz"))
def gazetteer_keys(b):
    return _tables(b)[1].select("key", "place", "state", "population", F.round("lat", 4).alias("lat"))


@query("ER-6, JN-11", sql("gaz located aliased resolved", "SELECT token, matched_by, city, state, population FROM resolved"))
def resolved_tokens(b):
    from talentgrid.functions import text as tx

    jobs, places, aliases, states, _ = _tables(b)
    tokens = jobs.select(F.explode(tx.location_tokens(tx.location_parts(F.col("location")))).alias("token"))
    return geo.resolve_tokens(tokens, places, aliases, states).select("token", "matched_by", "city", "state", "population")


@query("ER-8, ER-7", sql("gaz located aliased resolved job_place",
                         "SELECT job_id, CAST(rank AS INTEGER) AS rank, city, state, matched_by, population, tier FROM job_place"))
def job_cities(b):
    return geo.job_places(*_tables(b)).select("job_id", "rank", "city", "state", "matched_by", "population", "tier")


@query("ER-8, WIN-6", sql("gaz located aliased resolved job_place", "SELECT * FROM coded"))
def geocoded_jobs(b):
    tables = _tables(b)
    return geo.geocode(tables[0], geo.job_places(*tables)).drop("location", "primary_metro_region")


@query("AGG-6", sql("gaz located aliased resolved job_place", """
SELECT count(*) AS jobs, count(*) FILTER (n_places > 0) AS resolved_place, count(primary_city) AS resolved_city,
  count(*) FILTER (n_places > 0 AND primary_city IS NULL) AS state_only, count(*) FILTER (has_foreign_location AND n_places = 0) AS foreign_only,
  count(*) FILTER (work_mode = 'remote' AND n_places = 0) AS remote_only,
  count(*) FILTER (n_places = 0 AND work_mode <> 'remote' AND NOT has_foreign_location) AS unresolved,
  round(count(*) FILTER (n_places > 0) / greatest(count(*) FILTER (n_places > 0 OR work_mode <> 'remote'), 1)::DOUBLE, 4)::DOUBLE AS rate_excl_remote,
  count(*) FILTER (n_cities > 1) AS multi_city FROM coded"""))
def geography_audit(b):
    tables = _tables(b)
    return geo.place_audit(geo.geocode(tables[0], geo.job_places(*tables)))


@query("AGG-6 (methods)", sql("gaz located aliased resolved job_place", """
SELECT matched_by, count(*) AS places FROM job_place WHERE matched_by <> 'foreign' GROUP BY 1"""))
def match_methods(b):
    return geo.job_places(*_tables(b)).filter(F.col("matched_by") != "foreign").groupBy("matched_by").agg(
        F.count(F.lit(1)).alias("places"))


@query("AGG-6 (unresolved)", sql("gaz located aliased resolved job_place", """
SELECT token, count(*) AS mentions FROM token JOIN resolved USING (token) WHERE matched_by IS NULL GROUP BY token
ORDER BY mentions DESC, token LIMIT 30"""))
def unresolved_tokens(b):
    from talentgrid.functions import text as tx

    jobs, places, aliases, states, _ = _tables(b)
    tokens = jobs.select(F.explode(tx.location_tokens(tx.location_parts(F.col("location")))).alias("token"))
    open_tokens = geo.resolve_tokens(tokens, places, aliases, states).filter(F.col("matched_by").isNull())
    return tokens.join(open_tokens.select("token"), "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "token").limit(30)


@query("FN-9", """
SELECT c_custkey, CASE WHEN city IN ('Delhi', 'Noida') THEN 'Delhi NCR' WHEN city = 'Thane' THEN 'Mumbai MMR'
  WHEN city = 'Howrah' THEN 'Kolkata' END AS metro_region FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Delhi'
  WHEN 'FURNITURE' THEN 'Noida' WHEN 'MACHINERY' THEN 'Thane' WHEN 'BUILDING' THEN 'Howrah' ELSE 'Agra' END AS city FROM customer)""")
def metro_regions(b):
    s = F.col("c_mktsegment")
    city = F.when(s == "HOUSEHOLD", "Delhi").when(s == "FURNITURE", "Noida").when(s == "MACHINERY", "Thane").when(
        s == "BUILDING", "Howrah").otherwise("Agra")
    return b.raw("customer").select("c_custkey", geo.metro_region(city).alias("metro_region"))
