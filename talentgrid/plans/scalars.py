"""Scalar expressions applied to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.functions import text as tx
from talentgrid.plans.registry import query, sql

TAG_SQL = r"""regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g')"""
NORM_TAG_SQL = r"""CASE WHEN starts_with({0}, '.') THEN regexp_replace({0}, '[ \-_,;:/|]+$', '')
  ELSE regexp_replace({0}, '^[\s\-_.,;:/|]+|[\s\-_.,;:/|]+$', '', 'g') END"""


@query("FN-1", r"""
SELECT p_partkey, variant, """ + NORM_TAG_SQL.format("t") + """ AS tag FROM (
  SELECT p_partkey, variant, """ + TAG_SQL.format("raw") + """ AS t FROM (
    SELECT p_partkey, 'name' AS variant, '  ' || upper(p_name) || ' -, ' AS raw FROM part
    UNION ALL SELECT p_partkey, 'brand', '.' || p_brand || ' /' FROM part
    UNION ALL SELECT p_partkey, 'type', '|' || p_type || '  x.' FROM part))""")
def normalized_tags(b):
    variants = F.array(
        F.struct(F.lit("name").alias("variant"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" -, ")).alias("raw")),
        F.struct(F.lit("brand").alias("variant"), F.concat(F.lit("."), "p_brand", F.lit(" /")).alias("raw")),
        F.struct(F.lit("type").alias("variant"), F.concat(F.lit("|"), "p_type", F.lit("  x.")).alias("raw")),
    )
    return b.raw("part").select("p_partkey", F.inline(variants)).select(
        "p_partkey", "variant", tx.normalize_tag(F.col("raw")).alias("tag")
    )


@query("FN-2", r"""
SELECT doc_id, len(tags)::BIGINT AS n_tags, md5(array_to_string(tags, '|')) AS tags_md5 FROM (
  SELECT doc_id, list_filter(list_transform(list_filter(list_transform(parts, lambda p: {tag}),
      lambda t: length(t) > 0 AND length(t) <= 80), lambda t, i: struct_pack(t := t, i := i)),
      lambda s: list_position(kept, s.t) = s.i) AS s, list_transform(s, lambda x: x.t) AS tags
  FROM (SELECT doc_id, parts, list_filter(list_transform(parts, lambda p: {tag}),
      lambda t: length(t) > 0 AND length(t) <= 80) AS kept
    FROM (SELECT doc_id, list_transform(string_split(text, ','), lambda p: {pre}) AS parts FROM documents)))
""".format(pre=TAG_SQL.format("p"), tag=NORM_TAG_SQL.format("p")))
def tag_lists(b):
    tags = tx.split_tags(F.col("text"))
    return b.raw("documents").select("doc_id", tags.alias("tags")).select(
        "doc_id", F.size("tags").cast("long").alias("n_tags"), F.md5(F.array_join("tags", "|")).alias("tags_md5")
    )


@query("FN-3", r"""
SELECT page_id, trim(regexp_replace(lower(url), '[^0-9a-z+#]+', ' ', 'g')) AS url_key,
  md5(trim(regexp_replace(lower(html), '[^0-9a-z+#]+', ' ', 'g'))) AS html_key FROM pages""")
def normalized_titles(b):
    return b.raw("pages").select(
        "page_id", tx.normalize_title(F.col("url")).alias("url_key"),
        F.md5(tx.normalize_title(F.col("html"))).alias("html_key"),
    )


UPLOADED = """CASE event_type WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' Days Ago'
 WHEN 'view' THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '+ days ago' WHEN 'error' THEN 'Just Now'
 WHEN 'signup' THEN 'Few Hours Ago' ELSE 'Starts in 1-3 months' END"""


@query("FN-4", rf"""
SELECT event_id, CASE WHEN t IN ('just now', 'today', 'few hours ago') OR t LIKE '%hours ago' OR t LIKE '%hour ago' THEN 0.0
  ELSE TRY_CAST(regexp_extract(t, '^(\d+)\+?\s*days?\s+ago$', 1) AS DOUBLE) END::DOUBLE AS days_ago
FROM (SELECT event_id, lower(trim({UPLOADED})) AS t FROM events)""")
def upload_ages(b):
    days = F.floor("value").cast("long").cast("string")
    kind = F.col("event_type")
    uploaded = (
        F.when(kind == "click", F.concat(days, F.lit(" Days Ago")))
        .when(kind == "view", F.concat(F.lit(" "), days, F.lit("+ days ago")))
        .when(kind == "error", "Just Now").when(kind == "signup", "Few Hours Ago").otherwise("Starts in 1-3 months")
    )
    return b.raw("events").select("event_id", num.days_ago(uploaded).alias("days_ago"))


@query("FN-5", r"""
SELECT job_id, strftime(CASE WHEN regexp_matches(code, '^\d{6}') THEN try_strptime(substr(code, 1, 6), '%d%m%y') END,
  '%Y-%m-%d') AS posted FROM (SELECT o_orderkey AS job_id, CASE o_orderstatus
    WHEN 'P' THEN '99' || strftime(o_orderdate, '%m%y') || o_orderkey WHEN 'F' THEN strftime(o_orderdate, '%d%m%y') || '008041'
    ELSE 'id' || o_orderkey END AS code FROM orders)""")
def id_dates(b):
    date = F.col("o_orderdate").cast("timestamp")
    code = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("99"), F.date_format(date, "MMyy"), "o_orderkey"))
        .when(F.col("o_orderstatus") == "F", F.concat(F.date_format(date, "ddMMyy"), F.lit("008041")))
        .otherwise(F.concat(F.lit("id"), "o_orderkey"))
    )
    return b.raw("orders").select(
        F.col("o_orderkey").alias("job_id"), F.date_format(num.posting_date(code), "yyyy-MM-dd").alias("posted")
    )


@query("FN-6", """
SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL WHEN p_size - 2 <= 1 THEN '0-1' WHEN p_size - 2 < 3 THEN '1-3'
  WHEN p_size - 2 < 6 THEN '3-6' WHEN p_size - 2 < 10 THEN '6-10' ELSE '10+' END AS exp_band FROM part""")
def experience_bands(b):
    years = F.when(F.col("p_size") != 50, F.col("p_size") - 2).cast("double")
    return b.raw("part").select("p_partkey", num.experience_band(years).alias("exp_band"))


@query("FN-7", r"""
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(lower(
  regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 \-]', ' ', 'g'), '\s+', ' ', 'g'))) AS key
FROM conversations""")
def place_keys(b):
    return b.raw("conversations").select("conv_id", "turn", F.md5(tx.place_norm(F.col("text"))).alias("key"))


LOCATION = """CASE o_orderstatus WHEN 'P' THEN 'Hybrid - ' || n_name || ', Remote' WHEN 'F'
 THEN n_name || '(Old Town) / Pune and ' || r_name ELSE CASE WHEN n_nationkey < 12 THEN 'Remote, ' || n_name ELSE 'Work from Home' END END"""


@query("FN-8", rf"""
SELECT job_id, array_to_string(list_transform(list_filter(parts, lambda p: NOT p.remote), lambda p: p.token), '|') AS tokens,
  CASE WHEN len(list_filter(parts, lambda p: p.hybrid)) > 0 THEN 'hybrid'
    WHEN len(list_filter(parts, lambda p: p.remote)) > 0 THEN 'remote' ELSE 'onsite' END AS work_mode
FROM (SELECT job_id, list_transform(raw, lambda p: struct_pack(
    token := trim(regexp_replace(regexp_replace(p, '(?i)^\s*hybrid\s*[-:]\s*', ''), '\([^)]*\)', ' ', 'g'), ' -'),
    hybrid := regexp_matches(p, '(?i)^\s*hybrid\s*[-:]\s*'),
    remote := lower(p) LIKE 'remote%' OR lower(p) = 'work from home')) AS parts
  FROM (SELECT o_orderkey AS job_id, list_transform(string_split_regex({LOCATION}, '[,/;|]| and '), lambda p: trim(p)) AS raw
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey))""")
def parsed_locations(b):
    placed = b.raw("orders").join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        b.places, F.col("c_nationkey") == F.col("n_nationkey"))
    raw = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Hybrid - "), "state", F.lit(", Remote")))
        .when(F.col("o_orderstatus") == "F", F.concat("state", F.lit("(Old Town) / Pune and "), "region"))
        .when(F.col("n_nationkey") < 12, F.concat(F.lit("Remote, "), "state")).otherwise("Work from Home")
    )
    parts = placed.select(F.col("o_orderkey").alias("job_id"), tx.location_parts(raw).alias("parts"))
    return parts.select(
        "job_id", F.array_join(tx.location_tokens(F.col("parts")), "|").alias("tokens"),
        tx.work_mode(F.col("parts")).alias("work_mode"),
    )


@query("FN-10, FN-11", r"""
SELECT p_partkey, p_name || ' (' || p_type || ')' AS label, 'preferred' AS kind, CAST(0 AS INTEGER) AS priority FROM part
UNION ALL SELECT p_partkey, p_name, 'preferred_short', 1 FROM part
UNION ALL SELECT p_partkey, p_brand, 'alt', 2 FROM part UNION ALL SELECT p_partkey, p_type, 'alt', 2 FROM part
""")
def concept_label_variants(b):
    preferred = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    cell = F.concat("p_brand", F.lit("\n  \n "), "p_type")
    return b.raw("part").select("p_partkey", F.inline(tx.label_variants(preferred, tx.split_lines(cell))))


TITLE = "'Sr. ' || p_name || ' AI/ML ' || p_type || ' Engineer - L3 (Urgent ' || p_brand || ') hr & ' || p_brand"


@query("FN-12", rf"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower({TITLE}), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'),
  '\bai\s*/\s*ml\b', 'artificial intelligence machine learning', 'g'), '\bhr\b', 'human resources', 'g'),
  '[^a-z0-9+#/&\. ]+', ' ', 'g'),
  '\b(?:senior|sr|jr|junior|l[1-5]|hiring)\b', ' ', 'g'), '\b(?:sr|jr)\.', ' ', 'g'), '\s+', ' ', 'g'), ' -/.&') AS title
FROM part""")
def cleaned_titles(b):
    raw = F.concat(F.lit("Sr. "), "p_name", F.lit(" AI/ML "), "p_type", F.lit(" Engineer - L3 (Urgent "), "p_brand",
                   F.lit(") hr & "), "p_brand")
    return b.raw("part").select("p_partkey", tx.clean_title(raw).alias("title"))


@query("FN-13, ER-9", r"""
SELECT p_partkey, code, CASE WHEN regexp_matches(code, '^[1-9]\d{3}$') THEN code END AS family
FROM (SELECT p_partkey, regexp_replace(regexp_extract('http://x/isco/C' || lpad(CAST(p_partkey * 7 % 10000 AS VARCHAR), 4, '0'),
  '([^/]*)$', 1), '^[cC]', '') AS code FROM part)""")
def occupation_families(b):
    uri = F.concat(F.lit("http://x/isco/C"), F.lpad((F.col("p_partkey") * 7 % 10000).cast("string"), 4, "0"))
    code = num.group_code(uri)
    return b.raw("part").select("p_partkey", code.alias("code"), num.occupation_family(code).alias("family"))


@query("FN-14", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN s >= 0.8 AND s < 1.01 THEN '0.80+'
  WHEN s >= 0.7 AND s < 0.8 THEN '0.70-0.80' WHEN s >= 0.6 AND s < 0.7 THEN '0.60-0.70' ELSE '<0.60' END AS band
FROM (SELECT *, l_quantity / 50::DOUBLE AS s FROM lineitem)""")
def link_score_bands(b):
    method = F.when(F.col("l_returnflag") == "A", "exact").otherwise("embedding")
    return b.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        num.score_band(method, F.col("l_quantity") / F.lit(50.0)).alias("band"))


@query("FN-15", """
SELECT o_orderkey, ('0x' || substr(sha256('17:' || o_orderkey), 1, 8))::BIGINT % 100 AS bucket,
  CASE WHEN ('0x' || substr(sha256('17:' || o_orderkey), 1, 8))::BIGINT % 100 < 70 THEN 'train'
    WHEN ('0x' || substr(sha256('17:' || o_orderkey), 1, 8))::BIGINT % 100 < 80 THEN 'val'
    WHEN ('0x' || substr(sha256('17:' || o_orderkey), 1, 8))::BIGINT % 100 < 90 THEN 'test' ELSE 'pool' END AS split
FROM orders""")
def hash_splits(b):
    bucket = num.hash_bucket(F.col("o_orderkey"), "17:", 100)
    return b.raw("orders").select(
        "o_orderkey", bucket.alias("bucket"), num.named_split(bucket, num.RANKING_SPLIT).alias("split"))


ROLE_TEXT = """CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Sr Data  Engineer' WHEN 'FURNITURE' THEN 'Machine Learning lead'
 WHEN 'MACHINERY' THEN 'BI Developer' WHEN 'BUILDING' THEN 'Back Office' ELSE c_name END"""


@query("FN-16, FN-29", rf"""
SELECT c_custkey, CASE WHEN regexp_matches(t, 'data\s*architect') THEN 'Data architect'
  WHEN regexp_matches(t, 'data\s*engineer|etl|big\s*data') THEN 'Data engineer'
  WHEN regexp_matches(t, 'data\s*scientist|machine\s*learning|\bml\s*engineer') THEN 'Data scientist'
  WHEN regexp_matches(t, 'business\s*analyst') THEN 'Business analyst'
  WHEN regexp_matches(t, 'data\s*analyst|analytics|business intelligence|\bbi\b') THEN 'Data analyst'
  WHEN regexp_matches(t, 'developer|software|programmer') THEN 'Software'
  WHEN regexp_matches(t, 'operations|data entry|back office') THEN 'Operations' ELSE 'Other' END AS family,
  regexp_matches(t || ' typing', 'data entry|typing') AND regexp_matches(t, 'earn|present job|freelanc|home based') AS flagged
FROM (SELECT c_custkey, regexp_replace(lower(trim({ROLE_TEXT})), '\s+', ' ', 'g') AS t FROM customer)""")
def role_families(b):
    segment = F.col("c_mktsegment")
    title = (
        F.when(segment == "HOUSEHOLD", "Sr Data  Engineer").when(segment == "FURNITURE", "Machine Learning lead")
        .when(segment == "MACHINERY", "BI Developer").when(segment == "BUILDING", "Back Office").otherwise(F.col("c_name"))
    )
    return b.raw("customer").select(
        "c_custkey", tx.role_family(title).alias("family"),
        tx.quality_flag(F.concat(tx.normal(title), F.lit(" typing"))).alias("flagged"))


@query("FN-17", r"""
WITH raw AS (SELECT l_orderkey AS job_id, string_agg(CASE p_brand WHEN 'Brand#1' THEN 'ML' WHEN 'Brand#2' THEN 'PowerBI'
    ELSE p_name END, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
    || CASE WHEN max(l_quantity) > 40 THEN '...' ELSE '' END AS cell
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
view AS (SELECT job_id, lower(cell) LIKE '%...' AS truncated, string_split_regex(regexp_replace(lower(cell), '\.\.\.$', ''), '[,;|]') AS parts
  FROM raw)
SELECT job_id, truncated, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(
    CASE WHEN truncated THEN parts[1:len(parts) - 1] ELSE parts END, lambda p: trim(p)), lambda p: length(p) > 0),
    lambda p: CASE p WHEN 'ml' THEN 'machine learning' WHEN 'powerbi' THEN 'power bi' ELSE p END))), '|') AS skills,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(parts, lambda p: trim(p)),
    lambda p: length(p) > 0),
    lambda p: CASE p WHEN 'ml' THEN 'machine learning' WHEN 'powerbi' THEN 'power bi' ELSE p END))), '|') AS skills_permissive
FROM view""")
def skill_lists(b):
    line = b.raw("lineitem").join(b.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    name = (
        F.when(F.col("p_brand") == "Brand#1", "ML").when(F.col("p_brand") == "Brand#2", "PowerBI").otherwise(F.col("p_name"))
    )
    ordered = F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", name.alias("name"))))
    cells = line.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.concat(F.array_join(F.transform(ordered, lambda s: s["name"]), ", "),
                 F.when(F.max("l_quantity") > 40, "...").otherwise("")).alias("cell"))
    return cells.select(
        "job_id", F.col("cell").endswith("...").alias("truncated"),
        F.array_join(tx.skill_list(F.col("cell")), "|").alias("skills"),
        F.array_join(tx.skill_list(F.col("cell"), conservative=False), "|").alias("skills_permissive"))


SPELLED_STATES = [
    "  jammu &   Kashmir ", "JAMMU AND KASHMIR", "Andaman & N. Island", "andaman and nicobar\tislands", "The Dadra and Nagar Haveli and  Daman and Diu",
    "Dadra & Nagar Haveli & Daman & Diu", " Tamil   Nadu", "kerala", ""]


@query("FN-20", """
SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Jammu and Kashmir' WHEN 1 THEN 'Jammu and Kashmir' WHEN 2 THEN 'Andaman and Nicobar' WHEN 3 THEN 'Andaman and Nicobar'
  WHEN 4 THEN 'Dadra and Nagar Haveli and Daman and Diu' WHEN 5 THEN 'Dadra and Nagar Haveli and Daman and Diu' WHEN 6 THEN 'Tamil Nadu' WHEN 7 THEN 'kerala' ELSE '' END AS state
FROM customer""")
def canonical_states(b):
    spelled = F.element_at(F.array(*map(F.lit, SPELLED_STATES)), (F.col("c_custkey") % 9 + 1).cast("int"))
    return b.raw("customer").select("c_custkey", tx.canonical_state(spelled).alias("state"))


@query("FN-18, FN-19", r"""
SELECT p_partkey, TRY_CAST(regexp_extract(e, '^\s*(\d+)\s*-\s*(\d+)\s*yrs?\s*$', 1) AS DOUBLE) AS exp_min,
  TRY_CAST(regexp_extract(e, '^\s*(\d+)\s*-\s*(\d+)\s*yrs?\s*$', 2) AS DOUBLE) AS exp_max,
  TRY_CAST(trim(replace(pay, 'L', '')) AS DOUBLE) AS pay
FROM (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_size || ' years' ELSE ' ' || p_size || ' - ' || (p_size + 3) || ' yrs' END AS e,
  CASE WHEN p_type = 'SMALL' THEN 'n/a' ELSE CAST(p_size AS VARCHAR) || '.5 L' END AS pay FROM part)""")
def parsed_ranges_and_pay(b):
    from talentgrid.operators.ordinal import experience_range

    size = F.col("p_size")
    cell = F.when(F.col("p_type") == "PROMO", F.concat(size.cast("string"), F.lit(" years"))).otherwise(
        F.concat(F.lit(" "), size.cast("string"), F.lit(" - "), (size + 3).cast("string"), F.lit(" yrs")))
    pay = F.when(F.col("p_type") == "SMALL", "n/a").otherwise(F.concat(size.cast("string"), F.lit(".5 L")))
    low, high = experience_range(cell)
    return b.raw("part").select("p_partkey", low.alias("exp_min"), high.alias("exp_max"), num.native_pay(pay).alias("pay"))


@query("FN-21", r"""
SELECT doc_id, CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: x IN ('hai','hain','karna','karta','karti','aata','aati',
  'mujhe','mein','aur','kaam','ka','ki','ke','seekha','jaanta','jaanti','sakta','sakti','chalana','banana','likhna','bolna',
  'nahi'))) > 0.15 * len(w) THEN 'hi-Latn' ELSE 'en' END AS language
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def detected_languages(b):
    return b.raw("documents").select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query("FN-22", r"""
SELECT doc_id, md5(CASE WHEN len(keep) = 0 THEN '' ELSE trim(array_to_string(
    words[list_min(keep):list_max(keep)], ' '), ' .:()[]{}"''।॥') END) AS trimmed
FROM (SELECT doc_id, words, list_filter(list_transform(words, lambda w, i: CASE WHEN lower(trim(w, ' .:()[]{}"''।॥')) IN
    ('that', 'the', 'of', 'it', 'le', 'la', 'der', 'die') OR regexp_matches(lower(trim(w, ' .:()[]{}"''।॥')), '^\d+$')
    THEN NULL ELSE i END), lambda i: i IS NOT NULL) AS keep
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 0) AS words FROM documents))""")
def filler_trimmed_texts(b):
    filler = ["that", "the", "of", "it", "le", "la", "der", "die"]
    return b.raw("documents").select("doc_id", F.md5(tx.trim_filler(F.col("text"), filler)).alias("trimmed"))


@query("FN-23")
def document_phrases(b):
    phrases = tx.candidate_phrases(F.col("text"))
    return b.raw("documents").select("doc_id", phrases.alias("p")).select(
        "doc_id", F.size("p").cast("long").alias("n_phrases"), F.md5(F.array_join("p", "|")).alias("phrases_md5"))


@query("FN-24, FN-26, FN-30, FLT-9", """
SELECT o_orderkey, round(least(greatest(1 - o_totalprice / 100000 / 2, 0.0), 1.0), 8)::DOUBLE AS cosine,
  round_even(o_totalprice / 1000, 0)::DOUBLE * 1000 AS thousands,
  CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE substr(o_orderpriority, 1, 1) END || '|' ||
    CASE WHEN o_orderstatus = 'F' THEN '0' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS support_key,
  CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS finite_pay
FROM orders""")
def scored_orders(b):
    o = b.raw("orders")
    pay, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return o.select(
        "o_orderkey", F.round(num.l2_to_cosine(pay / 100000), 8).alias("cosine"),
        num.round_thousands(pay).alias("thousands"),
        num.support_key(F.when(status != "P", F.substring("o_orderpriority", 1, 1)),
                        F.when(status != "F", F.col("o_custkey") % 3)).alias("support_key"),
        num.finite(F.when(status == "O", float("nan")).otherwise(pay)).alias("finite_pay"))


@query("FN-25", """
SELECT l_returnflag, l_linestatus, s AS hits, n, round(greatest((p + z2 / (2 * n) - h) / (1 + z2 / n), 0), 6)::DOUBLE AS low,
  round(least((p + z2 / (2 * n) + h) / (1 + z2 / n), 1), 6)::DOUBLE AS high
FROM (SELECT *, 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) AS h FROM (
  SELECT *, s / n::DOUBLE AS p, 3.8416::DOUBLE AS z2 FROM (
    SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 45) AS s, count(*) AS n FROM lineitem GROUP BY ALL)))""")
def share_intervals(b):
    grouped = b.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("l_quantity") > 45).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = num.wilson_interval(F.col("hits"), F.col("n"))
    return grouped.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


@query("FN-27", """
SELECT dayname(o_orderdate) AS weekday, count(*) AS postings, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
  max(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS oldest FROM orders GROUP BY 1""")
def weekday_histogram(b):
    day = F.col("o_orderdate").cast("date")
    return b.raw("orders").groupBy(F.date_format(day, "EEEE").alias("weekday")).agg(
        F.count(F.lit(1)).alias("postings"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"),
        F.max(F.datediff(F.lit("2002-01-01").cast("date"), day)).cast("long").alias("oldest"))


@query("FN-28", sql("job_skill", """
SELECT job_id, bool_or(skill_id LIKE '%PROMO%') AS has_promo, bool_or(skill_id LIKE '%SMALL%') AS has_small,
  count(*) AS n_skills FROM job_skill GROUP BY job_id"""))
def keyword_features(b):
    from talentgrid.functions.distributed import item_sets

    sets = item_sets(b.job_skill, "job_id", "skill_id")
    return sets.select(
        "job_id", F.exists("items", lambda s: s.contains("PROMO")).alias("has_promo"),
        F.exists("items", lambda s: s.contains("SMALL")).alias("has_small"), F.size("items").cast("long").alias("n_skills"))
