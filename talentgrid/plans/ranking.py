"""Profiles against postings, skills, candidates and curricula."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions.distributed import best_per_group, item_sets
from talentgrid.operators import recommend as rec
from talentgrid.operators import topk
from talentgrid.plans import pay as paid
from talentgrid.plans.registry import PARTS, query, sql
from talentgrid.session import cut

WEIGHTED = "posting job_skill demand profile skill_df n_docs skill_stat"
TFIDF = WEIGHTED + " doc_norm query_norm tfidf"

PARTS["best10"] = """best10 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) AS rank FROM tfidf QUALIFY rank <= 10)"""
PARTS["fits"] = """fits AS (
  SELECT query_id, job_id, sum(w) AS covered, min(total) AS total FROM profile JOIN job_skill USING (skill_id) JOIN skill_weight USING (skill_id)
  JOIN (SELECT job_id, sum(w) AS total FROM job_skill JOIN skill_weight USING (skill_id) GROUP BY job_id) USING (job_id) GROUP BY query_id, job_id)"""


def _market(b):
    edges = b.job_skill
    return b.profiles, edges, rec.skill_statistics(edges)


@query("AGG-8", sql("job_skill skill_df n_docs skill_stat skill_weight", """
SELECT skill_id, df, round(idf, 6)::DOUBLE AS idf, w FROM skill_stat JOIN skill_weight USING (skill_id)"""))
def skill_weights(b):
    return rec.skill_statistics(b.job_skill).select("skill_id", "df", F.round("idf", 6).alias("idf"), "w")


@query("REC-11, REC-2, TOP-1, COV-1", sql(TFIDF + " skill_weight fits", """
SELECT query_id, job_id, covered::BIGINT AS covered, total::BIGINT AS total, 100 * covered >= 60 * total AS eligible,
  round(score, 6)::DOUBLE AS score FROM (SELECT * FROM tfidf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) <= 50)
  JOIN fits USING (query_id, job_id)"""))
def profile_best_postings(b):
    queries, edges, stats = _market(b)
    best = cut(topk.top_tfidf(queries, edges, stats, 50))
    fit = rec.fit_of(best, queries, edges, stats)
    return best.join(fit, ["query_id", "job_id"]).select(
        "query_id", "job_id", "covered", "total", "eligible", F.round("score", 6).alias("score"))


@query("REC-1", sql("posting job_skill", """
, pop AS (SELECT occupation, count(*) AS n FROM posting GROUP BY 1)
SELECT 'skill' AS kind, skill_id AS item, count(*) AS score FROM job_skill GROUP BY skill_id
UNION ALL SELECT 'posting', CAST(job_id AS VARCHAR), n FROM posting JOIN pop USING (occupation)"""))
def popularity(b):
    skills = rec.popularity_of_skills(b.job_skill).select(F.lit("skill").alias("kind"), F.col("skill_id").alias("item"), "score")
    jobs = rec.popularity_of_postings(b.postings).select(
        F.lit("posting").alias("kind"), F.col("job_id").cast("string").alias("item"), "score")
    return skills.unionByName(jobs)


@query("REC-2", sql(TFIDF, "SELECT query_id, job_id, round(score, 6)::DOUBLE AS score FROM tfidf"))
def tfidf_scores(b):
    return rec.tfidf_cosine(*_market(b)).select("query_id", "job_id", F.round("score", 6).alias("score"))


@query("REC-5, JN-12", sql(WEIGHTED + " adar", "SELECT query_id, job_id, round(score, 6)::DOUBLE AS score FROM adar"))
def adamic_adar_scores(b):
    return rec.adamic_adar(*_market(b)).select("query_id", "job_id", F.round("score", 6).alias("score"))


TOP = """
SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id)::INTEGER AS rank, round(score, 6)::DOUBLE AS score FROM {}
QUALIFY rank <= 20"""


@query("REC-2 (top k), TOP-1", sql(TFIDF, TOP.format("tfidf")))
def top_tfidf_postings(b):
    return topk.top_tfidf(*_market(b), 20).select("query_id", "job_id", "rank", F.round("score", 6).alias("score"))


@query("REC-5 (top k), JN-12", sql(WEIGHTED + " adar", TOP.format("adar")))
def top_adamic_adar_postings(b):
    return topk.top_adamic_adar(*_market(b), 20).select("query_id", "job_id", "rank", F.round("score", 6).alias("score"))


NEIGHBOUR = """
, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) AS rank FROM tfidf QUALIFY rank <= 200)"""


@query("REC-3", sql(TFIDF, NEIGHBOUR + """
SELECT query_id, skill_id, round(sum(score), 6)::DOUBLE AS score FROM near JOIN job_skill USING (job_id) WHERE rank <= 50 GROUP BY ALL"""))
def neighbour_skill_scores(b):
    queries, edges, stats = _market(b)
    near = rec.top_postings(rec.tfidf_cosine(queries, edges, stats), 50)
    return rec.neighbour_skills(near, edges).select("query_id", "skill_id", F.round("score", 6).alias("score"))


@query("REC-4", sql(TFIDF, NEIGHBOUR + """
, scored AS (SELECT k, query_id, skill_id, sum(score) AS score FROM near JOIN job_skill USING (job_id),
  unnest([20, 50, 100, 200]) AS u(k) WHERE rank <= k GROUP BY ALL),
ranked AS (SELECT k, query_id, skill_id FROM scored LEFT JOIN profile USING (query_id, skill_id) WHERE profile.skill_id IS NULL
  QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 9) DESC, skill_id) <= 10),
truth AS (SELECT occupation AS query_id, skill_id FROM demand QUALIFY row_number() OVER (PARTITION BY occupation ORDER BY postings DESC, skill_id) BETWEEN 9 AND 18)
SELECT CAST(k AS INTEGER) AS k, round(avg(recall), 6)::DOUBLE AS recall_at_10 FROM (
  SELECT k, query_id, count(*) FILTER (truth.skill_id IS NOT NULL) / 10.0 AS recall FROM ranked LEFT JOIN truth USING (query_id, skill_id) GROUP BY k, query_id)
GROUP BY k"""))
def neighbour_count_tuning(b):
    queries, edges, stats = _market(b)
    near = rec.top_postings(rec.tfidf_cosine(queries, edges, stats), 200)
    scored = rec.neighbour_grid(near, edges, [20, 50, 100, 200]).join(queries, ["query_id", "skill_id"], "left_anti")
    ranked = best_per_group(scored, ["k", "query_id"], [*rec.stable(), F.asc("skill_id")], 10)
    order = [F.desc("postings"), F.asc("skill_id")]
    truth = best_per_group(b.occupation_demand, ["occupation"], order, 18).filter(F.col("rank") > 8).select(
        F.col("occupation").alias("query_id"), "skill_id", F.lit(1).alias("hit"))
    recall = ranked.join(truth, ["query_id", "skill_id"], "left").groupBy("k", "query_id").agg(
        (F.count("hit") / 10).alias("recall"))
    return recall.groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall_at_10"))


@query("REC-6, JN-9", sql(WEIGHTED, """
, deg AS (SELECT job_id, 1 / ln(2.0::DOUBLE + count(*)) AS wj FROM job_skill GROUP BY job_id),
s AS (SELECT x.skill_id AS a, y.skill_id AS z, sum(wj) AS together FROM job_skill x JOIN job_skill y ON x.job_id = y.job_id AND x.skill_id <> y.skill_id
  JOIN deg ON deg.job_id = x.job_id GROUP BY ALL)
SELECT query_id, z AS skill_id, round(sum(inv * together), 6)::DOUBLE AS score FROM profile JOIN skill_stat USING (skill_id) JOIN s ON a = skill_id GROUP BY ALL"""))
def adamic_adar_skill_scores(b):
    queries, edges, stats = _market(b)
    return rec.adamic_adar_skills(queries, item_sets(edges, "job_id", "skill_id"), stats).select(
        "query_id", "skill_id", F.round("score", 6).alias("score"))


@query("JN-9", sql("job_skill", """
SELECT x.skill_id AS a, y.skill_id AS b, count(*) AS together FROM job_skill x JOIN job_skill y ON x.job_id = y.job_id AND x.skill_id < y.skill_id GROUP BY ALL"""))
def skill_cooccurrence(b):
    return rec.cooccurrence(item_sets(b.job_skill, "job_id", "skill_id"))


@query("REC-9", sql("job_skill skill_field", """
, dj AS (SELECT job_id, count(*) AS dj FROM job_skill GROUP BY 1), ds AS (SELECT skill_id, count(*) AS ds FROM job_skill GROUP BY 1),
links AS (SELECT job_id, skill_id, 1 / sqrt(dj * ds) AS a FROM job_skill JOIN dj USING (job_id) JOIN ds USING (skill_id)),
j1 AS (SELECT job_id, field AS dim, sum(a) AS v FROM links JOIN skill_field USING (skill_id) GROUP BY ALL),
s2 AS (SELECT skill_id, dim, sum(a * v) AS v FROM links JOIN j1 USING (job_id) GROUP BY ALL)
SELECT skill_id, dim, round(sum(v) / 4, 6)::DOUBLE AS value FROM (
  SELECT skill_id, field AS dim, 1.0::DOUBLE AS v FROM skill_field WHERE skill_id IN (SELECT skill_id FROM ds) UNION ALL SELECT * FROM s2) GROUP BY ALL"""))
def propagated_fields(b):
    edges = b.job_skill
    signal = b.skill_field.select("skill_id", F.col("field").alias("dim"), F.lit(1.0).alias("value")).join(
        edges.select("skill_id").distinct(), "skill_id", "left_semi")
    return rec.propagate(edges, signal).select("skill_id", "dim", F.round("value", 6).alias("value"))


OCCLUSION = TFIDF + " best10"


@query("REC-10", sql(OCCLUSION + " adar", """
SELECT query_id, job_id, skill_id, round(CASE WHEN js.job_id IS NULL THEN 0 ELSE inv END, 6)::DOUBLE AS adamic_drop,
  round(best10.score - (best10.score * norm * qnorm - CASE WHEN js.job_id IS NULL THEN 0 ELSE idf * idf END) / (sqrt(qnorm * qnorm - idf * idf) * norm), 5)::DOUBLE AS tfidf_drop
FROM best10 JOIN profile USING (query_id) JOIN skill_stat USING (skill_id) JOIN query_norm USING (query_id) JOIN doc_norm USING (job_id)
LEFT JOIN job_skill js USING (job_id, skill_id)"""))
def occlusion_drops(b):
    queries, edges, stats = _market(b)
    best = rec.top_postings(rec.tfidf_cosine(queries, edges, stats), 10)
    additive = rec.occlusion_adamic(queries, best, edges, stats)
    cosine = rec.occlusion_tfidf(queries, best, edges, stats).withColumnRenamed("drop", "cosine")
    return additive.join(cosine, ["query_id", "job_id", "skill_id"]).select(
        "query_id", "job_id", "skill_id", F.round("drop", 6).alias("adamic_drop"), F.round("cosine", 5).alias("tfidf_drop"))


@query("REC-12", sql(TFIDF + " best10 skill_weight fits", """
, lists AS (SELECT query_id, job_id, string_agg(skill_id, ',' ORDER BY w DESC, skill_id) FILTER (profile.skill_id IS NOT NULL) AS matched,
    array_to_string((list(skill_id ORDER BY w DESC, skill_id) FILTER (profile.skill_id IS NULL))[1:8], ',') AS missing
  FROM best10 JOIN job_skill USING (job_id) JOIN skill_weight USING (skill_id) LEFT JOIN profile USING (query_id, skill_id) GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, job_id, title, company, state, tier, occupation, round(score, 5)::DOUBLE AS score, round(covered / total, 4)::DOUBLE AS fit,
  matched, coalesce(missing, '') AS missing FROM best10 JOIN lists USING (query_id, job_id) JOIN fits USING (query_id, job_id) JOIN posting USING (job_id)"""))
def profile_match_report(b):
    queries, edges, stats = _market(b)
    best = cut(topk.top_tfidf(queries, edges, stats, 10))
    why = rec.explain_matches(best, queries, edges, stats)
    fit = rec.fit_of(best, queries, edges, stats).select("query_id", "job_id", "fit")
    details = b.postings.select("job_id", "title", "company", "state", "tier", "occupation")
    return best.join(why, ["query_id", "job_id"]).join(fit, ["query_id", "job_id"]).join(details, "job_id").select(
        "query_id", "rank", "job_id", "title", "company", "state", "tier", "occupation", F.round("score", 5).alias("score"),
        F.round("fit", 4).alias("fit"), F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


ANY_RANGE = """
, ranged AS (SELECT job_id, coalesce(lv1.a, lv2.a, lv3.a, lv4.a) AS p10, coalesce(lv1.m, lv2.m, lv3.m, lv4.m) AS p50, coalesce(lv1.z, lv2.z, lv3.z, lv4.z) AS p90 FROM posting p
  LEFT JOIN lv1 ON lv1.occupation = p.occupation AND lv1.tier = p.tier LEFT JOIN lv2 ON lv2.occupation = p.occupation LEFT JOIN lv3 ON lv3.isco2 = p.isco2, lv4)"""


def _pay_ranges(b, jobs):
    """Pay range of given postings, disclosed or not, learnt from disclosed training rows."""
    return _ranges_of(b, b.postings.join(jobs, "job_id", "left_semi"))


def _ranges_of(b, postings):
    return paid.py.predict_range(postings, paid._paid(b).filter("split = 'train'"), paid.LEVELS)


@query("REC-12 (contributions, pay)", sql(OCCLUSION + " paid range", ANY_RANGE + """
, drops AS (SELECT query_id, job_id, rank, skill_id, round(best10.score - CASE WHEN qnorm * qnorm - idf * idf > 1e-9 THEN
    (best10.score * norm * qnorm - CASE WHEN js.job_id IS NULL THEN 0 ELSE idf * idf END) / (sqrt(qnorm * qnorm - idf * idf) * norm) ELSE 0 END, 5) AS d
  FROM best10 JOIN profile USING (query_id) JOIN skill_stat USING (skill_id) JOIN query_norm USING (query_id) JOIN doc_norm USING (job_id) LEFT JOIN job_skill js USING (job_id, skill_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, job_id ORDER BY d DESC, skill_id) <= 6)
SELECT query_id, rank::INTEGER AS rank, job_id, round(any_value(p10), 6)::DOUBLE AS p10, round(any_value(p50), 6)::DOUBLE AS p50, round(any_value(p90), 6)::DOUBLE AS p90,
  string_agg(skill_id || ':' || CAST(round(d * 100000, 0) AS BIGINT), ',' ORDER BY d DESC, skill_id) AS contributions FROM drops JOIN ranged USING (job_id) GROUP BY query_id, rank, job_id"""))
def match_contributions(b):
    queries, edges, stats = _market(b)
    best = cut(topk.top_tfidf(queries, edges, stats, 10))
    parts = rec.contributions(best, queries, edges, stats).groupBy("query_id", "job_id").agg(F.array_sort(F.collect_list(F.struct("place", "skill_id", "drop"))).alias("c"))
    shown = F.transform("c", lambda c: F.concat(c["skill_id"], F.lit(":"), F.round(c["drop"] * 100000, 0).cast("long").cast("string")))
    pay = _pay_ranges(b, best.select("job_id").distinct()).select("job_id", *[F.round(q, 6).alias(q) for q in ("p10", "p50", "p90")])
    return best.join(parts, ["query_id", "job_id"]).join(pay, "job_id").select(
        "query_id", "rank", "job_id", "p10", "p50", "p90", F.array_join(shown, ",").alias("contributions"))


@query("REC-12 (paths)", sql(TFIDF + " best10 skill_weight", """
, start AS (SELECT query_id, job_id, skill_id, row_number() OVER (PARTITION BY query_id, job_id ORDER BY w DESC, skill_id) - 1 AS path
  FROM best10 JOIN job_skill USING (job_id) JOIN profile USING (query_id, skill_id) JOIN skill_weight USING (skill_id) QUALIFY path < 3),
step AS (SELECT query_id, job_id, path, 0 AS ord, 'input' AS kind, 'listed: ' || lower(skill_id) AS label FROM start WHERE skill_id LIKE '%|STANDARD'
  UNION ALL SELECT query_id, job_id, path, 1, 'skill', skill_id FROM start UNION ALL SELECT query_id, job_id, path, 2, 'posting', title || ' (' || company || ')' FROM start JOIN posting USING (job_id)
  UNION ALL SELECT query_id, job_id, path, 3, 'occupation', occupation FROM start JOIN posting USING (job_id))
SELECT query_id, job_id, path::INTEGER AS path, (row_number() OVER (PARTITION BY query_id, job_id, path ORDER BY ord) - 1)::INTEGER AS step, kind, label FROM step"""))
def match_evidence_paths(b):
    queries, edges, stats = _market(b)
    best = cut(topk.top_tfidf(queries, edges, stats, 10))
    sources = queries.filter(F.col("skill_id").endswith("|STANDARD")).withColumn("source_text", F.concat(F.lit("listed: "), F.lower("skill_id")))
    return rec.evidence_paths(rec.explain_matches(best, queries, edges, stats), b.postings, sources)


@query("REC-12 (roles)", sql(TFIDF + " requirement paid range", ANY_RANGE + """
, best AS (SELECT * FROM tfidf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) <= 500),
roles AS (SELECT query_id, occupation, sum(score) AS score, count(*) AS in_best FROM best JOIN posting USING (job_id) GROUP BY query_id, occupation
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, occupation) <= 8),
lack AS (SELECT query_id, r.occupation, d.skill_id, postings FROM roles r JOIN demand d ON d.occupation = r.occupation WHERE NOT EXISTS (FROM profile p WHERE p.query_id = r.query_id AND p.skill_id = d.skill_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, r.occupation ORDER BY postings DESC, d.skill_id) <= 6),
lacks AS (SELECT query_id, occupation, string_agg(skill_id, ',' ORDER BY postings DESC, skill_id) AS missing FROM lack GROUP BY ALL),
has AS (SELECT query_id, occupation, string_agg(skill_id, ',' ORDER BY skill_id) AS essential FROM roles JOIN requirement USING (occupation) JOIN profile USING (query_id, skill_id) WHERE relation = 'essential' GROUP BY ALL),
mid AS (SELECT occupation, quantile_cont(p10, 0.5) AS p10, quantile_cont(p50, 0.5) AS p50, quantile_cont(p90, 0.5) AS p90 FROM ranged JOIN posting USING (job_id) GROUP BY occupation)
SELECT query_id, occupation, round(score, 4)::DOUBLE AS score, in_best, missing, coalesce(essential, '') AS essential, round(p10, 6)::DOUBLE AS p10, round(p50, 6)::DOUBLE AS p50, round(p90, 6)::DOUBLE AS p90
FROM roles JOIN lacks USING (query_id, occupation) LEFT JOIN has USING (query_id, occupation) JOIN mid USING (occupation)"""))
def role_reports(b):
    from talentgrid.functions.distributed import exact_quantiles

    queries, edges, stats = _market(b)
    postings = b.postings
    # A profile per occupation meets most postings, so that bounds spare little.
    roles = cut(rec.role_scores(rec.tfidf_cosine(queries, edges, stats), postings))
    skills = rec.role_skills(roles, queries, None, None, b.requirements, demand=b.occupation_demand)
    jobs = postings.join(roles.select("occupation").distinct(), "occupation", "left_semi")
    long = _ranges_of(b, jobs).select("occupation", F.inline(F.array(*[
        F.struct(F.lit(q).alias("q"), F.col(q).alias("v")) for q in ("p10", "p50", "p90")])))
    middle = exact_quantiles(long, ["occupation", "q"], "v", {"m": 0.5}).groupBy("occupation").agg(*[
        F.max(F.when(F.col("q") == q, F.round("m", 6))).alias(q) for q in ("p10", "p50", "p90")])
    return roles.join(skills, ["query_id", "occupation"]).join(middle, "occupation").select(
        "query_id", "occupation", F.round("score", 4).alias("score"), "in_best", F.array_join("missing", ",").alias("missing"),
        F.array_join("essential", ",").alias("essential"), "p10", "p50", "p90")


@query("AGG-15, REC-12", sql(TFIDF, """
, best AS (SELECT * FROM tfidf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) <= 500),
roles AS (SELECT query_id, occupation, sum(score) AS score, count(*) AS in_best FROM best JOIN posting USING (job_id) GROUP BY query_id, occupation
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, occupation) <= 8),
pay AS (SELECT occupation, count(*) AS postings, quantile_cont(pay, 0.5) AS median_pay FROM posting GROUP BY 1)
SELECT query_id, occupation, round(score, 4)::DOUBLE AS score, in_best, postings, round(median_pay, 4)::DOUBLE AS median_pay FROM roles JOIN pay USING (occupation)"""))
def role_ranking(b):
    from talentgrid.functions.distributed import exact_quantiles

    queries, edges, stats = _market(b)
    postings = b.postings
    roles = rec.role_scores(rec.tfidf_cosine(queries, edges, stats), postings)
    counts = postings.groupBy("occupation").agg(F.count(F.lit(1)).alias("postings"))
    pay = exact_quantiles(postings, ["occupation"], "pay", {"median_pay": 0.5})
    return roles.join(counts, "occupation").join(pay, "occupation").select(
        "query_id", "occupation", F.round("score", 4).alias("score"), "in_best", "postings",
        F.round("median_pay", 4).alias("median_pay"))


@query("COV-19", sql(TFIDF, """
, best AS (SELECT * FROM tfidf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, job_id) <= 200)
SELECT query_id, isco2, count(*) AS votes FROM best JOIN posting USING (job_id) GROUP BY query_id, isco2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, isco2) = 1"""))
def inferred_target_groups(b):
    queries, edges, stats = _market(b)
    return rec.target_group(rec.tfidf_cosine(queries, edges, stats), b.postings)


@query("REC-13", sql("posting job_skill demand profile skill_df n_docs skill_weight", """
, cand AS (SELECT DISTINCT company_id AS candidate_id, skill_id FROM posting JOIN job_skill USING (job_id)),
size AS (SELECT candidate_id, count(*) AS n FROM cand GROUP BY 1), want AS (SELECT query_id, sum(w) AS total FROM profile JOIN skill_weight USING (skill_id) GROUP BY 1)
SELECT query_id, candidate_id, round(sum(w) / min(total)::DOUBLE, 4)::DOUBLE AS coverage, round(sum(w) / min(total)::DOUBLE + 0.01::DOUBLE * ln(1 + min(n)::DOUBLE), 5)::DOUBLE AS score
FROM profile JOIN skill_weight USING (skill_id) JOIN cand USING (skill_id) JOIN size USING (candidate_id) JOIN want USING (query_id) GROUP BY ALL"""))
def candidate_ranking(b):
    queries, edges, stats = _market(b)
    owned = b.postings.select("job_id", F.col("company_id").alias("candidate_id")).join(edges, "job_id").select(
        "candidate_id", "skill_id").distinct()
    return rec.rank_candidates(queries, owned, stats)


@query("REC-13 (limit)", sql("posting job_skill demand profile skill_df n_docs skill_weight", """
, cand AS (SELECT DISTINCT company_id AS candidate_id, skill_id FROM posting JOIN job_skill USING (job_id)),
size AS (SELECT candidate_id, count(*) AS n FROM cand GROUP BY 1), want AS (SELECT query_id, skill_id, w, sum(w) OVER (PARTITION BY query_id) AS total FROM profile JOIN skill_weight USING (skill_id)),
scored AS (SELECT query_id, candidate_id, sum(w) / min(total)::DOUBLE AS cov, round(sum(w) / min(total)::DOUBLE + 0.01::DOUBLE * ln(1 + min(n)::DOUBLE), 5)::DOUBLE AS score
  FROM want JOIN cand USING (skill_id) JOIN size USING (candidate_id) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM scored QUALIFY rank <= 25)
SELECT query_id, rank::INTEGER AS rank, candidate_id, any_value(score) AS score, round(any_value(cov), 4)::DOUBLE AS coverage, coalesce(string_agg(skill_id, ',' ORDER BY w DESC, skill_id) FILTER (c.skill_id IS NOT NULL), '') AS matched,
  coalesce(string_agg(skill_id, ',' ORDER BY w DESC, skill_id) FILTER (c.skill_id IS NULL), '') AS missing
FROM best JOIN want USING (query_id) LEFT JOIN cand c USING (candidate_id, skill_id) GROUP BY query_id, rank, candidate_id"""))
def best_candidates(b):
    queries, edges, stats = _market(b)
    owned = b.postings.select("job_id", F.col("company_id").alias("candidate_id")).join(edges, "job_id").select(
        "candidate_id", "skill_id").distinct()
    best = rec.best_candidates(queries, owned, stats, 25)
    return best.withColumns({c: F.array_join(c, ",") for c in ("matched", "missing")})


PARTS["standing"] = """scope AS (SELECT state AS scope, job_id FROM posting), size AS (SELECT scope, count(*) AS n FROM scope GROUP BY 1),
syllabus AS (SELECT DISTINCT state AS scope, skill_id FROM posting JOIN profile ON query_id = occupation),
cnt AS (SELECT scope, skill_id, count(*) AS postings FROM scope JOIN job_skill USING (job_id) GROUP BY ALL),
standing AS (SELECT scope, skill_id, postings, round(postings / n::DOUBLE, 4)::DOUBLE AS share, CASE WHEN syllabus.skill_id IS NULL THEN 'missing' ELSE 'covered' END AS standing
  FROM (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY scope ORDER BY postings DESC, skill_id) <= 40) LEFT JOIN syllabus USING (scope, skill_id) JOIN size USING (scope)
  UNION ALL SELECT scope, skill_id, coalesce(postings, 0), round(coalesce(postings, 0) / n::DOUBLE, 4)::DOUBLE, 'low_demand' FROM syllabus LEFT JOIN cnt USING (scope, skill_id) JOIN size USING (scope)
  WHERE coalesce(postings, 0) / n::DOUBLE < 0.002)"""


def _standing(b):
    postings = b.postings
    scopes = postings.select(F.col("state").alias("scope"), "job_id")
    taught = postings.select(F.col("state").alias("scope"), F.col("occupation").alias("query_id")).distinct().join(
        b.profiles, "query_id").select("scope", "skill_id").distinct()
    return rec.curriculum(scopes, b.job_skill, taught)


@query("REC-14", sql("posting job_skill demand profile standing", "SELECT * FROM standing"))
def curriculum_standing(b):
    return _standing(b)


@query("REC-14 (coverage)", sql("posting job_skill demand profile standing", """
SELECT scope, round(sum(CASE WHEN standing = 'covered' THEN postings ELSE 0 END) / sum(postings)::DOUBLE, 4)::DOUBLE AS coverage, count(*) AS top_skills
FROM standing WHERE standing <> 'low_demand' GROUP BY scope"""))
def curriculum_coverage(b):
    return rec.curriculum_coverage(_standing(b))


@query("REC-15", sql("posting job_skill demand profile", """
SELECT query_id, job_id, count(*) AS overlap, min(n) AS required, round(count(*) / min(n)::DOUBLE, 6)::DOUBLE AS score
FROM profile JOIN job_skill USING (skill_id) JOIN (SELECT job_id, count(*) AS n FROM job_skill GROUP BY 1) USING (job_id) GROUP BY query_id, job_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) / min(n)::DOUBLE DESC, job_id) <= 12"""))
def overlap_matches(b):
    scored = rec.overlap_share(b.profiles, b.job_skill)
    best = best_per_group(scored, ["query_id"], [F.desc("score"), F.asc("job_id")], 12)
    return best.select("query_id", "job_id", "overlap", "required", F.round("score", 6).alias("score"))


@query("REC-8")
def latent_skill_scores(b):
    return rec.latent_scores(b.job_skill, b.profiles).select("query_id", "skill_id", F.round("score", 3).alias("score"))
