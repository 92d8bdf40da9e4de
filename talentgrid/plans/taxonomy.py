"""Taxonomy and posting graph tables, gaps, ancestors and catalogue searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import catalog as cat
from talentgrid.operators import taxonomy as tax
from talentgrid.plans.linking import tag_links
from talentgrid.plans.registry import PARTS, query, sql

REQ = "posting job_skill demand requirement"


def catalog(b):
    """The taxonomy datasets expressed over the test tables."""
    occ = b.postings.select("occupation", "isco2").distinct()
    skills = b.skill_field
    brand = b.raw("part").select("p_brand").distinct()
    empty = b.spark.createDataFrame([], "conceptUri string, preferredLabel string, altLabels string, description string, status string")
    family = F.concat(F.lit("Family "), F.substring("p_brand", 7, 1))
    kind = F.col("field")
    return {
        "occupations_core": occ.select(
            F.col("occupation").alias("conceptUri"), F.col("occupation").alias("preferredLabel"), F.lit("").alias("altLabels"),
            F.lit("").alias("description"), F.col("isco2").alias("iscoGroup"), F.lit("ok").alias("status"),
            F.concat(F.lit("scheme/all scheme/"), "isco2").alias("inScheme")),
        "occupations_research": empty,
        "skills_core": skills.select(
            F.col("skill_id").alias("conceptUri"), F.col("skill_id").alias("preferredLabel"), F.col("field").alias("altLabels"),
            F.lit("").alias("description"), F.when(kind == "PROMO", "skill/competence").otherwise("knowledge").alias("skillType"),
            F.lit("").alias("reuseLevel"), F.lit("ok").alias("status"), F.lit("scheme/all  scheme/none").alias("inScheme")),
        "occupation_skill_relations": b.requirements.select(
            F.col("occupation").alias("occupationUri"), F.col("skill_id").alias("skillUri"), F.col("relation").alias("relationType")),
        "skill_skill_relations": skills.select(
            F.col("skill_id").alias("originalSkillUri"), F.concat(F.lit("Brand#1|"), "field").alias("relatedSkillUri"),
            F.lit("optional").alias("relationType")),
        "skills_hierarchy": brand.select(
            F.lit("root").alias("Level 0 URI"), F.lit("Root").alias("Level 0 preferred term"), family.alias("Level 1 URI"),
            family.alias("Level 1 preferred term"), F.col("p_brand").alias("Level 2 URI"), F.col("p_brand").alias("Level 2 preferred term"),
            F.lit("").alias("Level 3 URI"), F.lit("").alias("Level 3 preferred term")),
        "skills_broader_relations": skills.select(
            F.col("skill_id").alias("conceptUri"), F.col("skill_group").alias("broaderUri")).unionByName(
            brand.select(F.col("p_brand").alias("conceptUri"), F.lit("missing group").alias("broaderUri"))),
        "skill_groups": brand.select(F.col("p_brand").alias("conceptUri"), F.col("p_brand").alias("preferredLabel")),
        "isco_groups": occ.select(F.concat(F.lit("group/"), "isco2").alias("conceptUri"), F.col("isco2").alias("preferredLabel"),
                                  F.col("isco2").alias("code")).distinct(),
        "occupation_broader_relations": occ.select(
            F.col("occupation").alias("conceptUri"), F.concat(F.col("isco2"), F.lit("|1-URGENT")).alias("broaderUri")),
        "concept_schemes": occ.select(F.concat(F.lit("scheme/"), "isco2").alias("conceptSchemeUri"), F.col("isco2").alias("preferredLabel")).unionByName(
            b.spark.createDataFrame([("scheme/all", "all"), ("scheme/empty", "empty")], "conceptSchemeUri string, preferredLabel string")).distinct(),
        "digital_skills": skills.filter(kind == "PROMO").select(F.col("skill_id").alias("conceptUri")),
        **{name: empty for name in ("green_skills", "digcomp_skills", "research_skills", "transversal_skills", "language_skills")},
    }


@query("GR-1, AGG-12, SRC-8", sql("posting job_skill demand requirement skill_field", """
, occ AS (SELECT DISTINCT occupation, isco2 FROM posting), brand AS (SELECT DISTINCT p_brand FROM part),
rows AS (SELECT 'node' AS kind, 'Occupation' AS name, count(*) AS n FROM occ UNION ALL SELECT 'node', 'Skill', count(*) FROM skill_field
UNION ALL SELECT 'node', 'SkillGroup', count(*) + count(DISTINCT substr(p_brand, 7, 1)) + 1 FROM brand UNION ALL SELECT 'node', 'OccupationGroup', count(DISTINCT isco2) FROM occ
UNION ALL SELECT 'node', 'ConceptScheme', count(DISTINCT isco2) + 2 FROM occ UNION ALL SELECT 'edge', 'REQUIRES', count(*) FROM requirement
UNION ALL SELECT 'edge', 'RELATED_SKILL', count(*) FROM skill_field WHERE 'Brand#1|' || field IN (SELECT skill_id FROM skill_field)
UNION ALL SELECT 'edge', 'IN_SKILL_GROUP', count(*) FROM skill_field
UNION ALL SELECT 'edge', 'BROADER_THAN_SKILL_GROUP', count(*) + count(DISTINCT substr(p_brand, 7, 1)) FROM brand
UNION ALL SELECT 'edge', 'IN_OCC_GROUP', count(*) FROM occ UNION ALL SELECT 'edge', 'BROADER_OCCUPATION', count(*) FROM occ
UNION ALL SELECT 'edge', 'BROADER_THAN_OCC_GROUP', 0 UNION ALL SELECT 'edge', 'IN_SCHEME', (SELECT 2 * count(*) FROM occ) + (SELECT count(*) FROM skill_field))
SELECT * FROM rows"""))
def taxonomy_sizes(b):
    datasets = catalog(b)
    nodes = tax.taxonomy_nodes(datasets)
    return tax.size_table(nodes, tax.taxonomy_edges(datasets, nodes))


def _posting_graph(b):
    postings = b.postings
    cities = postings.select("job_id", F.lit(0).alias("rank"), F.when(F.col("tier") > 1, F.col("region")).alias("city"), "state")
    return tax.posting_graph(postings, cities, b.job_tag, tag_links(b))


@query("GR-2, AGG-12", sql("posting job_tag tag_link", """
, j AS (SELECT *, CASE WHEN tier > 1 THEN region END AS city FROM posting)
SELECT 'node' AS kind, 'Job' AS name, count(*) AS n FROM j UNION ALL SELECT 'node', 'Company', count(DISTINCT lower(trim(company))) FROM j
UNION ALL SELECT 'node', 'City', count(DISTINCT city || '|' || state) FROM j UNION ALL SELECT 'node', 'State', count(DISTINCT state) FROM j
UNION ALL SELECT 'node', 'ExperienceBand', count(DISTINCT exp_band) FROM j UNION ALL SELECT 'node', 'Tag', count(*) FROM tag_link
UNION ALL SELECT 'edge', 'POSTS', count(*) FROM j UNION ALL SELECT 'edge', 'LOCATED_IN', count(city) FROM j
UNION ALL SELECT 'edge', 'IN_STATE', (SELECT count(DISTINCT city || '|' || state) FROM j) + (SELECT count(*) FROM j WHERE city IS NULL)
UNION ALL SELECT 'edge', 'NEEDS_EXP', count(*) FROM j UNION ALL SELECT 'edge', 'TAGGED', count(*) FROM job_tag
UNION ALL SELECT 'edge', 'SAME_AS', count(*) FILTER (accepted) FROM tag_link
UNION ALL SELECT 'edge', 'REQUIRES', count(*) FROM (SELECT DISTINCT job_id, uri FROM job_tag JOIN tag_link USING (tag) WHERE accepted)
UNION ALL SELECT 'edge', 'MAPS_TO', count(*) FROM j"""))
def posting_graph_sizes(b):
    return tax.size_table(*_posting_graph(b))


@query("GR-3", """
WITH RECURSIVE e AS (SELECT DISTINCT 'P' || p_partkey AS src, 'P' || p_partkey // 3 AS dst FROM part WHERE p_partkey > 0),
up AS (SELECT src AS node, dst AS ancestor, 1 AS hops FROM e UNION ALL SELECT node, dst, hops + 1 FROM up JOIN e ON src = ancestor WHERE hops < 5)
SELECT node, ancestor, min(hops)::INTEGER AS hops FROM up GROUP BY node, ancestor""")
def group_ancestors(b):
    key = F.col("p_partkey")
    edges = b.raw("part").filter(key > 0).select(
        F.concat(F.lit("P"), key.cast("string")).alias("src"), F.concat(F.lit("P"), F.floor(key / 3).cast("string")).alias("dst"))
    return tax.ancestors(edges)


@query("GR-4", """
WITH skill AS (SELECT DISTINCT p_brand || '|' || p_type AS uri, p_brand, p_type FROM part),
fields AS (SELECT DISTINCT p_type AS uri, CASE p_type WHEN 'SMALL' THEN 'field unknown' ELSE 'Field ' || p_type END AS field FROM part
  UNION ALL SELECT DISTINCT 'Family ' || substr(p_brand, 7, 1), 'Family field ' || substr(p_brand, 7, 1) FROM part)
SELECT uri AS skill_id, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Field PROMO' ELSE 'Family field ' || substr(p_brand, 7, 1) END AS field FROM skill WHERE p_type <> 'SMALL' AND p_type = 'PROMO'
UNION ALL SELECT uri, 'Family field ' || substr(p_brand, 7, 1) FROM skill WHERE p_type NOT IN ('PROMO', 'SMALL')""")
def skill_broad_fields(b):
    part = b.raw("part")
    skill = F.concat_ws("|", "p_brand", "p_type")
    family = F.concat(F.lit("Family "), F.substring("p_brand", 7, 1))
    broader = (
        part.filter(F.col("p_type").isin("PROMO", "SMALL")).select(skill.alias("src"), F.col("p_type").alias("dst"))
        .unionByName(part.select(skill.alias("src"), F.col("p_brand").alias("dst")))
        .unionByName(part.select(F.col("p_brand").alias("src"), family.alias("dst"))).distinct()
    )
    label = F.when(F.col("p_type") == "SMALL", "field unknown").otherwise(F.concat(F.lit("Field "), "p_type"))
    fields = part.select(F.col("p_type").alias("uri"), label.alias("field")).unionByName(
        part.select(family.alias("uri"), F.concat(F.lit("Family field "), F.substring("p_brand", 7, 1)).alias("field"))).distinct()
    return tax.nearest_field(part.select(skill.alias("uri")).distinct(), broader, fields)


PARTS["gap"] = """want AS (SELECT state AS query_id, occupation FROM posting GROUP BY state, occupation UNION ALL SELECT DISTINCT state, 'no such occupation' FROM posting),
own AS (SELECT state AS query_id, skill_id FROM posting JOIN job_skill USING (job_id) GROUP BY ALL HAVING count(*) >= 18),
gap AS (SELECT w.query_id, w.occupation, coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (relation = 'essential'), '') AS essential,
  coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (relation = 'optional'), '') AS optional,
  coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (o.skill_id IS NOT NULL), '') AS matched,
  coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (o.skill_id IS NULL), '') AS missing,
  round(100 * count(o.skill_id) / nullif(count(r.skill_id), 0)::DOUBLE, 1)::DOUBLE AS match_pct, CASE WHEN w.occupation = 'no such occupation' THEN 'unknown occupation' END AS error
  FROM want w LEFT JOIN requirement r ON r.occupation = w.occupation LEFT JOIN own o ON o.query_id = w.query_id AND o.skill_id = r.skill_id GROUP BY w.query_id, w.occupation)"""


@query("GR-5, SET-2", sql(REQ + " gap", "SELECT * FROM gap"))
def occupation_skill_gaps(b):
    postings = b.postings
    real = postings.select(F.col("state").alias("query_id"), "occupation", F.lit(True).alias("known")).distinct()
    odd = postings.select(F.col("state").alias("query_id"), F.lit("no such occupation").alias("occupation"), F.lit(False).alias("known")).distinct()
    owned = postings.select("job_id", F.col("state").alias("query_id")).join(b.job_skill, "job_id").groupBy("query_id", "skill_id").agg(
        F.count(F.lit(1)).alias("n")).filter("n >= 18").drop("n")
    gaps = tax.skill_gaps(real.unionByName(odd), b.requirements, owned)
    return gaps.select("query_id", "occupation", *[F.array_join(c, ",").alias(c) for c in ("essential", "optional", "matched", "missing")],
                       "match_pct", "error")


@query("GR-6, JN-4", sql("posting job_skill demand requirement profile skill_df n_docs skill_stat", """
, member AS (SELECT DISTINCT occupation, isco2 AS grp FROM posting), keep AS (SELECT DISTINCT isco2 AS filter_id, occupation FROM posting),
dots AS (SELECT query_id, occupation, sum(idf * idf) AS dot FROM profile JOIN requirement USING (skill_id) JOIN skill_stat USING (skill_id) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(idf * idf)) AS qn FROM profile JOIN skill_stat USING (skill_id) GROUP BY 1), onorm AS (SELECT occupation, sqrt(sum(idf * idf)) AS n FROM requirement JOIN skill_stat USING (skill_id) GROUP BY 1)
SELECT query_id, occupation, round(dot / (qn * n), 6)::DOUBLE AS score, hits, round(100 * hits / 30.0::DOUBLE, 1)::DOUBLE AS match_pct FROM dots JOIN qn USING (query_id) JOIN onorm USING (occupation)
JOIN keep ON filter_id = split_part(query_id, '|', 1) AND keep.occupation = dots.occupation JOIN (SELECT query_id, occupation, count(*) AS hits FROM profile JOIN requirement USING (skill_id) GROUP BY ALL) h USING (query_id, occupation)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (qn * n), 9) DESC, occupation) <= 3""".replace("JOIN (SELECT query_id, occupation, count(*) AS hits", "JOIN (SELECT query_id, occupation, count(*) AS hits")
    .replace("SELECT query_id, occupation, round(dot", "SELECT dots.query_id, dots.occupation, round(dot").replace("USING (query_id, occupation)\nQUALIFY", "ON h.query_id = dots.query_id AND h.occupation = dots.occupation\nQUALIFY")
    .replace("PARTITION BY query_id ORDER BY round(dot / (qn * n), 9) DESC, occupation", "PARTITION BY dots.query_id ORDER BY round(dot / (qn * n), 9) DESC, dots.occupation")
    .replace("JOIN qn USING (query_id) JOIN onorm USING (occupation)\n", "JOIN qn ON qn.query_id = dots.query_id JOIN onorm ON onorm.occupation = dots.occupation\n").replace("split_part(query_id", "split_part(dots.query_id")))
def recommended_occupations(b):
    """Occupations inside the profile's own group, filtered before ranking, with gap figures."""
    from talentgrid.functions.distributed import best_per_group
    from talentgrid.operators import recommend as rec

    groups = b.postings.select("occupation", F.concat(F.lit("group/"), "isco2").alias("grp"), F.col("isco2").alias("code")).distinct()
    wanted = groups.select(F.col("code").alias("filter_id"), "grp", "code").distinct()
    hierarchy = b.spark.createDataFrame([], "src string, dst string")
    allowed = tax.occupations_in_groups(groups, wanted, hierarchy)
    profiles = b.profiles
    texts = b.requirements.select(F.col("occupation").alias("job_id"), "skill_id")
    scores = rec.tfidf_cosine(profiles, texts, rec.skill_statistics(b.job_skill)).withColumn(
        "filter_id", F.split("query_id", r"\|")[0]).withColumnRenamed("job_id", "occupation").join(
        allowed, ["filter_id", "occupation"], "left_semi")
    best = best_per_group(scores, ["query_id"], [F.desc(F.round("score", 9)), F.asc("occupation")], 3)
    gaps = tax.skill_gaps(best.select("query_id", "occupation", F.lit(True).alias("known")), b.requirements, profiles)
    return best.join(gaps, ["query_id", "occupation"]).select(
        "query_id", "occupation", F.round("score", 6).alias("score"), F.size("matched").cast("long").alias("hits"), "match_pct")


@query("GR-7", sql("job_skill skill_df n_docs", """
, top AS (SELECT skill_id, df FROM skill_df ORDER BY df DESC, skill_id LIMIT 100),
co AS (SELECT x.skill_id AS a, y.skill_id AS b, count(*) AS postings FROM job_skill x JOIN job_skill y ON x.job_id = y.job_id AND x.skill_id < y.skill_id
  WHERE x.skill_id IN (SELECT skill_id FROM top) AND y.skill_id IN (SELECT skill_id FROM top) GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, postings, round(ln(postings * n / (t.df * u.df)::DOUBLE), 6)::DOUBLE AS weight FROM co JOIN top t ON t.skill_id = a JOIN top u ON u.skill_id = b, n_docs
WHERE ln(postings * n / (t.df * u.df)::DOUBLE) > 0 ORDER BY round(ln(postings * n / (t.df * u.df)::DOUBLE), 9) DESC, a, b LIMIT 360"""))
def skill_constellation(b):
    return tax.constellation(b.job_skill, 100, 360, 5).withColumn("weight", F.round("weight", 6))


@query("GR-7 (occupations)", sql("posting job_skill demand skill_df n_docs", """
, size AS (SELECT occupation, count(*) AS size FROM posting WHERE job_id IN (SELECT job_id FROM job_skill) GROUP BY 1),
lift AS (SELECT occupation, skill_id, postings, (postings / size::DOUBLE) / (df / n::DOUBLE) AS lift FROM demand JOIN size USING (occupation) JOIN skill_df USING (skill_id), n_docs WHERE postings >= 10)
SELECT occupation, skill_id, postings, round(ln(lift), 6)::DOUBLE AS weight FROM lift QUALIFY row_number() OVER (PARTITION BY occupation ORDER BY round(lift, 9) DESC, skill_id) <= 4"""))
def characteristic_skills(b):
    return tax.characteristic_skills(b.postings, b.job_skill).withColumn("weight", F.round("weight", 6))


@query("JN-13", sql("posting job_skill job_tag tag_link", """
, t AS (SELECT job_id, uri AS skill_id, tag, score, method FROM job_tag JOIN tag_link USING (tag) WHERE accepted QUALIFY row_number() OVER (PARTITION BY job_id, uri ORDER BY score DESC, tag) = 1)
SELECT job_id, skill_id, tag, round(score, 4)::DOUBLE AS score, method, title, occupation, state FROM job_skill LEFT JOIN t USING (job_id, skill_id) LEFT JOIN posting USING (job_id)"""))
def evidence_paths(b):
    jobs = b.postings.select("job_id", "title", "occupation", "state")
    paths = tax.evidence_paths(b.job_skill, b.job_tag, tag_links(b).filter("accepted"), jobs)
    return paths.select("job_id", "skill_id", "tag", F.round("score", 4).alias("score"), "method", "title", "occupation", "state")


@query("FLT-5, TOP-2", sql(REQ, """
SELECT DISTINCT occupation AS uri, lower(occupation) AS label FROM posting WHERE lower(occupation) LIKE '%ur%' AND isco2 IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY')
  AND occupation IN (SELECT occupation FROM requirement WHERE skill_id LIKE 'Brand#1|%') ORDER BY label, uri LIMIT 5 OFFSET 1"""))
def occupation_search(b):
    occ = b.postings.select(F.col("occupation").alias("uri"), F.col("occupation").alias("label"), "isco2").distinct()
    groups = occ.select(F.col("uri").alias("src"), F.col("isco2").alias("dst"))
    requires = b.requirements.select(F.col("occupation").alias("src"), F.col("skill_id").alias("dst"))
    kinds = ["SMALL", "LARGE", "PROMO", "MEDIUM", "ECONOMY", "STANDARD"]
    found = cat.search_occupations(occ, "UR", groups, ["HOUSEHOLD", "FURNITURE", "MACHINERY"], requires,
                                   [f"Brand#1|{k}" for k in kinds], offset=1, limit=5)
    return found.select("uri", F.lower("label").alias("label"))


@query("FLT-6", sql("skill_field", """
SELECT skill_id AS uri, lower(skill_id) AS label FROM skill_field WHERE field = 'PROMO' AND skill_id LIKE '%Brand#2%'
  AND (skill_id IN (SELECT skill_id FROM skill_field WHERE field = 'PROMO')) ORDER BY label, uri LIMIT 20"""))
def skill_search(b):
    skills = b.skill_field.select(F.col("skill_id").alias("uri"), F.col("skill_id").alias("label"), F.col("field").alias("skill_type"))
    related = b.skill_field.select(F.col("skill_id").alias("src"), F.concat(F.lit("Brand#1|"), "field").alias("dst"))
    found = cat.search_skills(skills, "brand#2", "PROMO", related=related, related_to="Brand#1|PROMO")
    return found.select("uri", F.lower("label").alias("label"))


@query("FLT-7", sql("skill_field", """
SELECT * FROM (SELECT 'skill' AS kind, skill_id AS label FROM skill_field WHERE lower(skill_id) LIKE '%eco%' ORDER BY skill_id LIMIT 7)
UNION ALL SELECT * FROM (SELECT 'group', skill_group FROM skill_field GROUP BY skill_group ORDER BY lower(skill_group) LIMIT 7)"""))
def label_autocomplete(b):
    skills = b.skill_field.select(F.col("skill_id").alias("uri"), F.col("skill_id").alias("label"))
    groups = b.skill_field.select(F.col("skill_group").alias("uri"), F.col("skill_group").alias("label")).distinct()
    return cat.autocomplete(skills, "ECO", 7).select(F.lit("skill").alias("kind"), "label").unionByName(
        cat.autocomplete(groups, None, 7, fold_case=True).select(F.lit("group").alias("kind"), "label"))


@query("FLT-4, FLT-11, TOP-2", sql("posting job_skill", """
, hit AS (SELECT * FROM posting WHERE lower(title) LIKE '%household%' AND tier = 2)
SELECT job_id, title, state, round(pay * 0.9, 2)::DOUBLE AS pay_low, round(pay * 1.1, 2)::DOUBLE AS pay_high, (SELECT count(*) FROM hit) AS total,
  coalesce((SELECT string_agg(skill_id, ',' ORDER BY skill_id) FROM job_skill s WHERE s.job_id = p.job_id), '') AS skills
FROM (SELECT * FROM hit ORDER BY job_id LIMIT 25 OFFSET 50) p"""))
def posting_search(b):
    from talentgrid.functions.distributed import item_sets

    page = cat.search_postings(b.postings, "HouseHold", 2, None, 50, 25)
    skills = item_sets(b.job_skill.join(page.select("job_id"), "job_id", "left_semi"), "job_id", "skill_id")
    return page.join(skills, "job_id", "left").select(
        "job_id", "title", "state", F.round(F.col("pay") * 0.9, 2).alias("pay_low"), F.round(F.col("pay") * 1.1, 2).alias("pay_high"),
        "total", F.coalesce(F.array_join("items", ","), F.lit("")).alias("skills"))


@query("AGG-13", sql("posting skill_field", """
, occ AS (SELECT DISTINCT occupation, isco2 FROM posting)
SELECT 'scheme/' || isco2 AS uri, count(*) AS members FROM occ GROUP BY isco2 UNION ALL SELECT 'scheme/all', (SELECT count(*) FROM occ) + (SELECT count(*) FROM skill_field)"""))
def concept_schemes_in_use(b):
    datasets = catalog(b)
    nodes = tax.taxonomy_nodes(datasets)
    return cat.schemes_in_use(nodes["ConceptScheme"], tax.taxonomy_edges(datasets, nodes)["IN_SCHEME"]).select("uri", "members")


@query("SET-1", """
SELECT uri, any_value(src) AS src FROM (SELECT c_mktsegment AS uri, 'core' AS src FROM customer UNION ALL SELECT o_orderpriority, 'research' FROM orders
  UNION ALL SELECT 'BUILDING', 'research') WHERE NOT (uri = 'BUILDING' AND src = 'research') GROUP BY uri""")
def merged_concepts(b):
    from talentgrid.functions.distributed import pick_one

    core = b.raw("customer").select(F.col("c_mktsegment").alias("uri"), F.lit("core").alias("src"), F.lit(0).alias("part"))
    research = b.raw("orders").select(F.col("o_orderpriority").alias("uri"), F.lit("research").alias("src"), F.lit(1).alias("part"))
    extra = b.raw("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_mktsegment").alias("uri"), F.lit("research").alias("src"), F.lit(1).alias("part"))
    return pick_one(core.unionByName(research).unionByName(extra), ["uri"], [F.asc("part")]).select("uri", "src")


@query("FLT-1, FLT-2", sql("posting job_skill skill_field", """
, f AS (SELECT job_id, field, count(*) AS n FROM job_skill JOIN skill_field USING (skill_id) GROUP BY ALL),
jf AS (SELECT job_id, field FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, field) = 1)
SELECT job_id, occupation, state FROM posting WHERE isco2 = 'BUILDING' AND exp_band IN ('0-1', '1-3', '10+') AND tier IN (1, 2)
  AND job_id IN (SELECT job_id FROM jf WHERE field = 'PROMO')"""))
def scoped_postings(b):
    from talentgrid.operators.workforce import posting_fields

    fields = posting_fields(b.job_skill, b.skill_field.select("skill_id", "field"))
    return cat.market_pool(b.postings, isco2="BUILDING", exp_bands=["0-1", "1-3", "10+"], tiers=[1, 2], fields=fields, field="PROMO").select(
        "job_id", "occupation", "state")


@query("FLT-10", sql("job_tag", """
SELECT job_id, tag FROM job_tag WHERE tag IN (SELECT tag FROM job_tag GROUP BY tag HAVING count(*) >= 900)"""))
def frequent_posting_tags(b):
    return cat.frequent_terms(b.job_tag, "job_id", "tag", 900)
