"""Concept linking over part names and supplied vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.operators import linking as lk
from talentgrid.plans.registry import PARTS, query, sql

PARTS["tag_link"] = """tag_link AS (
  SELECT tag, freq, uri, ('0x' || substr(sha256('s:' || tag), 1, 8))::BIGINT % 50 / 100.0::DOUBLE + 0.45 AS score,
    CASE WHEN ('0x' || substr(sha256('m:' || tag), 1, 8))::BIGINT % 4 = 0 THEN 'exact' ELSE 'embedding' END AS method, method = 'exact' OR score >= 0.7 AS accepted
  FROM (SELECT tag, count(*) AS freq FROM job_tag GROUP BY tag) JOIN (SELECT p_name AS tag, p_brand || '|' || p_type AS uri FROM part GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, uri) = 1) USING (tag))"""
PARTS["tag_link"] = PARTS["tag_link"].replace("ORDER BY count(*) DESC, uri) = 1", "ORDER BY count(*) DESC, p_brand || '|' || p_type) = 1").replace("GROUP BY 1, 2\n", "GROUP BY p_name, p_brand || '|' || p_type\n")


def tag_links(b):
    from talentgrid.functions.distributed import pick_one

    freq = b.job_tag.groupBy("tag").agg(F.count(F.lit(1)).alias("freq"))
    skills = b.raw("part").groupBy(F.col("p_name").alias("tag"), F.concat_ws("|", "p_brand", "p_type").alias("uri")).agg(
        F.count(F.lit(1)).alias("n"))
    best = pick_one(skills, ["tag"], [F.desc("n"), F.asc("uri")]).drop("n")
    score = num.hash_bucket(F.col("tag"), "s:", 50) / F.lit(100.0) + 0.45
    method = F.when(num.hash_bucket(F.col("tag"), "m:", 4) == 0, "exact").otherwise("embedding")
    return freq.join(best, "tag").withColumns({"score": score, "method": method}).withColumn(
        "accepted", (F.col("method") == "exact") | (F.col("score") >= 0.7))


def part_labels(b):
    return lk.concept_labels(b.raw("part").select(
        F.col("p_partkey").cast("string").alias("uri"),
        F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand").alias("preferred"),
        F.array("p_brand").alias("alternates")))


@query("ER-10", """
WITH lab AS (SELECT CAST(p_partkey AS VARCHAR) AS uri, lower(p_name || ' (' || p_type || ') ' || p_brand) AS key, 0 AS prio FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), lower(p_name || ' ' || p_brand), 1 FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), lower(p_brand), 2 FROM part),
best AS (SELECT key, min(uri) AS uri FROM lab JOIN (SELECT key, min(prio) AS prio FROM lab GROUP BY key) USING (key, prio) GROUP BY key HAVING count(DISTINCT uri) = 1),
txt AS (SELECT DISTINCT p_name || ' ' || p_brand AS text FROM part UNION SELECT DISTINCT upper(p_name || ' (' || p_type || ') ' || p_brand) FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT text, uri FROM txt LEFT JOIN best ON key = lower(text)""")
def exact_label_links(b):
    part = b.raw("part")
    texts = part.select(F.explode(F.array(
        F.concat_ws(" ", "p_name", "p_brand"), F.upper(F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "), "p_brand")),
        F.col("p_brand"))).alias("text")).distinct()
    return lk.exact_links(texts, part_labels(b)).select("text", "uri")


PARTS["label_vec"] = """centre AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(e) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS e, unnest(generate_series(1, 64)) AS d FROM embeddings) GROUP BY label, d) GROUP BY label),
label_vec AS (SELECT CAST(label AS VARCHAR) AS uri, list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v)))::FLOAT)::DOUBLE[] AS vector FROM centre
  UNION ALL SELECT CAST(label AS VARCHAR), arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label
  UNION ALL SELECT CAST(label AS VARCHAR), arg_max(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label),
pooled AS (SELECT vec_id AS query_id, uri, max(list_inner_product(embedding::DOUBLE[], vector)) AS score FROM embeddings, label_vec GROUP BY ALL)"""


def label_vectors(b):
    from talentgrid.functions.vectors import unit

    vectors = b.raw("embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("d", "e")).groupBy("label", "d").agg(
        F.avg(F.col("e").cast("double")).alias("m"))
    centre = unit(cells.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda c: c["m"]).alias("vector"))).select(
        "label", F.lit(0).alias("kind"), F.col("vector").cast("array<float>").alias("vector"))
    ends = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("first"), F.max_by("embedding", "vec_id").alias("last"))
    rows = centre.unionByName(ends.select("label", F.lit(1).alias("kind"), F.col("first").alias("vector"))).unionByName(
        ends.select("label", F.lit(2).alias("kind"), F.col("last").alias("vector")))
    return rows.select((F.col("label") * 3 + F.col("kind")).cast("long").alias("label_id"),
                       F.col("label").cast("string").alias("uri"), "vector")


@query("JN-10, ER-11, WIN-2", sql("label_vec", """
SELECT query_id, uri, round(score, 5)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uri) AS rank FROM pooled QUALIFY rank <= 3"""))
def vector_concept_candidates(b):
    queries = b.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = lk.vector_candidates(queries, label_vectors(b), 3)
    return found.select("query_id", "uri", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ER-12", sql("label_vec", """
, best AS (SELECT CAST(query_id AS VARCHAR) AS text, uri, round(score, 4)::DOUBLE AS score FROM pooled QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uri) = 1)
SELECT text, CASE WHEN length(text) = 1 THEN text ELSE uri END AS uri, CASE WHEN length(text) = 1 THEN 1.0 ELSE score END::DOUBLE AS score,
  CASE WHEN length(text) = 1 THEN 'exact' ELSE 'embedding' END AS method, length(text) = 1 OR score >= 0.5 AS accepted FROM best"""))
def concept_links(b):
    texts = b.raw("embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"))
    names = label_vectors(b).select("uri").distinct().select(
        "uri", F.col("uri").alias("preferred"), F.array().cast("array<string>").alias("alternates"))
    return lk.link(texts, lk.concept_labels(names), label_vectors(b), 0.4, single_word=0.5).select(
        "text", "uri", "score", "method", "accepted")


@query("ER-18, UDF-1")
def trigram_concept_links(b):
    from talentgrid.session import cut

    labels = cut(part_labels(b).withColumn("label_id", F.xxhash64("uri", "kind", "label")))
    vectors = lk.hashed_vectors(labels.select("label_id", "uri", F.col("label").alias("text"))).drop("text")
    texts = lk.hashed_vectors(b.job_tag.select(F.col("tag").alias("text")).distinct())
    return lk.link(texts, labels, vectors, 0.6, single_word=0.8, k=2).select(
        "text", "uri", F.round("score", 3).alias("score"), "method", "accepted")


@query("ER-13", sql("posting job_skill demand requirement", """
, cand AS (SELECT job_id, occ AS occupation, row_number() OVER (PARTITION BY job_id ORDER BY diff, occ) - 1 AS pos, CASE WHEN diff = 0 AND NOT disclosed THEN 1.0 ELSE 0.8 - 0.02 * diff END::DOUBLE AS score
  FROM (SELECT job_id, disclosed, o.occupation AS occ, abs(CAST(substr(title, 1, 1) AS INTEGER) - CAST(split_part(o.occupation, '|', 2)[1] AS INTEGER)) AS diff
    FROM posting p JOIN (SELECT DISTINCT occupation, isco2 FROM posting) o ON o.isco2 = p.isco2)),
n AS (SELECT job_id, count(*) AS n FROM job_skill GROUP BY 1), hit AS (SELECT job_id, occupation, sum(CASE relation WHEN 'essential' THEN 1.0 ELSE 0.5 END) AS hit
  FROM cand JOIN job_skill USING (job_id) JOIN requirement USING (occupation, skill_id) GROUP BY ALL),
rows AS (SELECT job_id, occupation, pos, score, max(score) OVER (PARTITION BY job_id) AS top, n, coalesce(hit / n, 0)::DOUBLE AS overlap FROM cand LEFT JOIN n USING (job_id) LEFT JOIN hit USING (job_id, occupation))
SELECT job_id, occupation, round(score, 6)::DOUBLE AS title_sim, round(overlap, 6)::DOUBLE AS overlap FROM rows WHERE CASE WHEN top >= 1 OR n IS NULL THEN pos = 0 ELSE score >= top - 0.05 END
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY round(0.7 * score + 0.3 * overlap, 9) DESC, pos) = 1"""))
def reranked_titles(b):
    from pyspark.sql import Window

    postings = b.postings
    occupations = postings.select(F.col("occupation").alias("occ"), "isco2").distinct()
    diff = F.abs(F.substring("title", 1, 1).cast("int") - F.substring(F.element_at(F.split("occ", r"\|"), 2), 1, 1).cast("int"))
    paired = postings.join(occupations, "isco2").withColumn("diff", diff)
    pos = F.row_number().over(Window.partitionBy("job_id").orderBy("diff", "occ")) - 1
    score = F.when((F.col("diff") == 0) & ~F.col("disclosed"), 1.0).otherwise(F.lit(0.8) - 0.02 * F.col("diff"))
    candidates = paired.select("job_id", pos.alias("pos"), F.col("occ").alias("occupation"), score.alias("score"))
    best = lk.rerank_titles(candidates, b.job_skill, b.requirements, alpha=0.7, margin=0.05)
    return best.select("job_id", "occupation", F.round("title_sim", 6).alias("title_sim"), F.round("overlap", 6).alias("overlap"))


@query("AGG-7", sql("job_tag tag_link", """
SELECT threshold, round(avg((method = 'exact' OR score >= threshold)::INTEGER), 6)::DOUBLE AS unique_share,
  round(sum(CASE WHEN method = 'exact' OR score >= threshold THEN freq ELSE 0 END) / sum(freq)::DOUBLE, 6)::DOUBLE AS mention_share
FROM tag_link, (SELECT unnest([0.6, 0.65, 0.7, 0.75, 0.8, 0.85]::DOUBLE[]) AS threshold) GROUP BY threshold"""))
def link_coverage_by_threshold(b):
    table = lk.link_coverage(tag_links(b), [0.6, 0.65, 0.7, 0.75, 0.8, 0.85])
    return table.select("threshold", F.round("unique_share", 6).alias("unique_share"), F.round("mention_share", 6).alias("mention_share"))


@query("AGG-7 (methods)", sql("job_tag tag_link", """
SELECT method, count(*) AS texts, sum(freq)::BIGINT AS mentions, count(*) FILTER (accepted) AS accepted, 0::BIGINT AS guard_refused FROM tag_link GROUP BY method"""))
def link_method_counts(b):
    return lk.method_counts(tag_links(b), 0.7)


@query("AGG-7 (unlinked)", sql("job_tag tag_link", "SELECT tag, freq FROM tag_link WHERE NOT accepted ORDER BY freq DESC, tag LIMIT 50"))
def unlinked_tags(b):
    return tag_links(b).filter(~F.col("accepted")).select("tag", "freq").orderBy(F.desc("freq"), "tag").limit(50)


@query("SET-3, JN-6", sql("job_tag tag_link", "SELECT DISTINCT job_id, uri AS skill_id FROM job_tag JOIN tag_link USING (tag) WHERE accepted"))
def linked_job_skills(b):
    return lk.job_skills_from_tags(b.job_tag, tag_links(b))


@query("ER-17", sql("job_tag tag_link", """
, lab AS (SELECT CAST(p_partkey AS VARCHAR) AS uri, lower(p_name || ' (' || p_type || ') ' || p_brand) AS key, 0 AS prio FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), lower(p_name || ' ' || p_brand), 1 FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), lower(p_brand), 2 FROM part),
named AS (SELECT key, uri FROM lab QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio, uri) = 1)
SELECT * FROM named UNION ALL SELECT lower(tag), uri FROM tag_link WHERE accepted AND freq >= 5 AND lower(tag) NOT IN (SELECT key FROM named)"""))
def extraction_dictionary(b):
    return lk.extraction_dictionary(part_labels(b), tag_links(b))


@query("ER-19, JN-2", sql("posting job_skill demand", """
, r AS (SELECT occupation AS uri, skill_id, row_number() OVER (PARTITION BY occupation ORDER BY postings DESC, skill_id) AS pos FROM demand QUALIFY pos <= 30)
SELECT uri, lower(uri || '. ' || any_value(isco2) || ' postings. ' || string_agg(skill_id, ' ' ORDER BY pos)) AS text
FROM r JOIN (SELECT DISTINCT occupation AS uri, isco2 FROM posting) USING (uri) GROUP BY uri"""))
def concept_search_texts(b):
    from talentgrid.functions.distributed import best_per_group

    relations = best_per_group(b.occupation_demand, ["occupation"], [F.desc("postings"), F.asc("skill_id")], 30, "pos").select(
        F.col("occupation").alias("uri"), "pos", F.col("skill_id").alias("skill_uri"))
    skills = b.skill_field.select(F.col("skill_id").alias("skill_uri"), F.col("skill_id").alias("name"))
    concepts = b.postings.select(
        F.col("occupation").alias("uri"), F.col("occupation").alias("label"),
        F.concat("isco2", F.lit(" postings")).alias("description")).distinct()
    return lk.concept_texts(concepts, relations, skills)


@query("REC-16", sql("posting job_skill demand profile skill_field", """
, vec AS (SELECT skill_id, embedding::DOUBLE[] AS v FROM (SELECT skill_id, row_number() OVER (ORDER BY skill_id) - 1 AS i FROM skill_field) JOIN embeddings ON vec_id = i),
qm AS (SELECT id, list(m ORDER BY d) AS v FROM (SELECT query_id AS id, d, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, unnest(generate_series(1, 64)) AS d FROM profile JOIN vec USING (skill_id)) GROUP BY ALL) GROUP BY id),
om AS (SELECT id, list(m ORDER BY d) AS v FROM (SELECT occupation AS id, d, avg(x) AS m FROM (SELECT occupation, unnest(v) AS x, unnest(generate_series(1, 64)) AS d FROM (SELECT DISTINCT occupation, skill_id FROM demand WHERE postings >= 2) JOIN vec USING (skill_id)) GROUP BY ALL) GROUP BY id)
SELECT q.id AS query_id, o.id AS occupation, round(list_inner_product(q.v, o.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(o.v, o.v)), 4)::DOUBLE AS score FROM qm q, om o"""))
def mean_vector_scores(b):
    from talentgrid.functions.distributed import cumulative
    from talentgrid.functions.vectors import nearest
    from talentgrid.operators.recommend import mean_vectors

    position = cumulative(b.skill_field.select("skill_id"), [], "skill_id").select(
        "skill_id", F.col("before").alias("vec_id"))
    vectors = position.join(b.raw("embeddings"), "vec_id").select("skill_id", F.col("embedding").alias("vector"))
    wanted = b.occupation_demand.filter("postings >= 2").select(F.col("occupation").alias("item_id"), "skill_id")
    scores = nearest(mean_vectors(b.profiles, "query_id", vectors), mean_vectors(wanted, "item_id", vectors), 25)
    return scores.select("query_id", F.col("item_id").alias("occupation"), F.round("score", 4).alias("score"))


@query("REC-7")
def text_matched_skills(b):
    from talentgrid.functions.vectors import nearest

    texts = concept_search_texts(b)
    vectors = lk.hashed_vectors(texts).select("uri", "vector")
    near = nearest(vectors.withColumnRenamed("uri", "query_id"), vectors.withColumnRenamed("uri", "item_id"), 20, exclude_same=True)
    weight = F.when(F.col("relation") == "essential", 1.0).otherwise(0.5)
    return near.join(b.requirements.withColumnRenamed("occupation", "item_id"), "item_id").groupBy("query_id", "skill_id").agg(
        F.round(F.sum(F.col("score") * weight), 4).alias("score"))
