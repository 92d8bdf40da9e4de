"""Scoring of postings and skills for tables of profiles.

Every scorer takes `queries(query_id, skill_id)` and `edges(job_id, skill_id)`, both distinct, and returns only pairs that
share a skill; a missing pair scores 0. `edges` should be partitioned by job_id: skill statistics and profiles of proven
size are broadcast to them, and the groupings then reuse that partitioning without another shuffle. Beyond the size bound
the joins on skill_id shuffle instead, with very common skills split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.distributed import best_per_group, dense_numbers, item_pairs
from talentgrid.functions.vectors import nearest, unit
from talentgrid.session import broadcast_if_small, cut

WEIGHT_SCALE = 1000
PAIRS_PER_TASK = 1_000_000  # (query, posting) pairs that a task sums and ranks at most, about


def skill_statistics(edges: DataFrame) -> DataFrame:
    """Per skill: postings listing it (df), all postings (n), idf, inverse log degree and the integer weight w."""
    n = edges.agg(F.countDistinct("job_id").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return broadcast_if_small(
        edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n.scalar())
        .withColumns({
            "idf": idf, "inv": 1 / F.log(2.0 + F.col("df")),
            "w": F.bround(WEIGHT_SCALE * idf, 0).cast("long"),
        })
    )


def stable(score: str = "score") -> list[Column]:
    """Descending order that ignores rounding noise of parallel sums."""
    return [F.desc(F.round(score, 9))]


def top_postings(scores: DataFrame, k: int) -> DataFrame:
    return best_per_group(scores, ["query_id"], [*stable(), F.asc("job_id")], k)


def top_skills(scores: DataFrame, k: int) -> DataFrame:
    return best_per_group(scores, ["query_id"], [*stable(), F.asc("skill_id")], k)


def popularity_of_skills(edges: DataFrame) -> DataFrame:
    return edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("score"))


def popularity_of_postings(postings: DataFrame) -> DataFrame:
    """Each posting scored by the number of postings of its occupation; no occupation scores 0."""
    demand = postings.groupBy("occupation").agg(F.count(F.lit(1)).alias("demand"))
    return postings.join(demand, "occupation", "left").select(
        "job_id", F.when(F.col("occupation").isNull(), 0).otherwise(F.coalesce("demand", F.lit(0))).alias("score"))


def query_terms(queries: DataFrame, stats: DataFrame, *columns: str) -> DataFrame:
    """Weight and other columns of every skill of every profile, broadcast when the table is small."""
    return broadcast_if_small(queries.join(stats.select("skill_id", *columns), "skill_id"))


def dealt(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """`edges` dealt out by posting so finely that what a task scores does not grow with the tables; `terms` holds each skill's df.

    Sizes in bytes, by which tasks are merged otherwise, say little here: a few bytes of a posting make a row per query.
    """
    pairs = terms.agg(F.sum("df")).first()[0] or 0
    if pairs <= PAIRS_PER_TASK:
        return edges
    return edges.repartition(max(-(-pairs // PAIRS_PER_TASK), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "job_id")


def tfidf_cosine(queries: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    square = F.col("idf") * F.col("idf")
    terms = query_terms(queries, stats, "idf", "df")
    lengths = terms.groupBy("query_id").agg(F.sqrt(F.sum(square)).alias("qnorm"))
    weighted = broadcast_if_small(terms.join(lengths, "query_id").select("query_id", "skill_id", square.alias("term"), "qnorm"))
    norms = edges.join(stats.select("skill_id", "idf"), "skill_id").groupBy("job_id").agg(F.sqrt(F.sum(square)).alias("norm"))
    dots = dealt(edges, terms).join(weighted, "skill_id").groupBy("query_id", "job_id").agg(F.sum("term").alias("dot"), F.max("qnorm").alias("qnorm"))
    return dots.join(norms, "job_id").select(
        "query_id", "job_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def adamic_adar(queries: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    terms = query_terms(queries, stats, "inv", "df")
    return dealt(edges, terms).join(terms.drop("df"), "skill_id").groupBy("query_id", "job_id").agg(F.sum("inv").alias("score"))


def coverage_fit(queries: DataFrame, edges: DataFrame, stats: DataFrame, tau_pct: int = 60) -> DataFrame:
    """Integer covered and total weight of each posting that shares a skill, its fit, and eligibility at `tau_pct`."""
    totals = edges.join(stats.select("skill_id", "w"), "skill_id").groupBy("job_id").agg(F.sum("w").alias("total"))
    covered = edges.join(query_terms(queries, stats, "w"), "skill_id").groupBy("query_id", "job_id").agg(F.sum("w").alias("covered"))
    return covered.join(totals, "job_id").select(
        "query_id", "job_id", "covered", "total", (F.col("covered") / F.col("total")).alias("fit"),
        (100 * F.col("covered") >= tau_pct * F.col("total")).alias("eligible"))


def fit_of(pairs: DataFrame, queries: DataFrame, edges: DataFrame, stats: DataFrame, tau_pct: int = 60) -> DataFrame:
    """`coverage_fit` of given (query_id, job_id) pairs alone; pairs without a shared skill have fit 0."""
    owned = broadcast_if_small(queries.withColumn("owned", F.lit(True)))
    listed = edges.join(broadcast_if_small(pairs.select("query_id", "job_id")), "job_id").join(stats.select("skill_id", "w"), "skill_id")
    sums = listed.join(owned, ["query_id", "skill_id"], "left").groupBy("query_id", "job_id").agg(
        F.coalesce(F.sum(F.when(F.col("owned"), F.col("w"))), F.lit(0)).alias("covered"), F.sum("w").alias("total"))
    return sums.select(
        "query_id", "job_id", "covered", "total", (F.col("covered") / F.col("total")).alias("fit"),
        (100 * F.col("covered") >= tau_pct * F.col("total")).alias("eligible"))


def cooccurrence(sets: DataFrame, weight: Column | None = None) -> DataFrame:
    """Pair counts (a < b) over item sets, or sums of a per-set weight such as 1/ln(2 + set size)."""
    if weight is None:
        return item_pairs(sets).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    return item_pairs(sets.withColumn("_w", weight), ["_w"]).groupBy("a", "b").agg(F.sum("_w").alias("together"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "together"))


def adamic_adar_skills(queries: DataFrame, sets: DataFrame, stats: DataFrame) -> DataFrame:
    """Skill completion through shared postings: Σ over owned skills of inverse degree × weighted co-occurrence."""
    pairs = both_ways(cooccurrence(sets, 1 / F.log(2.0 + F.size("items"))))
    # Dealt out by query, so that what meets a small table of pairs is summed where it is.
    owned = queries.join(stats.select("skill_id", "inv"), "skill_id").withColumnRenamed("skill_id", "a").repartition("query_id")
    return owned.join(broadcast_if_small(pairs), "a").groupBy("query_id", F.col("b").alias("skill_id")).agg(
        F.sum(F.col("inv") * F.col("together")).alias("score"))


def neighbour_skills(neighbours: DataFrame, edges: DataFrame) -> DataFrame:
    """Skill scores of a query: sum of the similarities of its chosen neighbour postings that list the skill."""
    return edges.join(neighbours.select("query_id", "job_id", "score"), "job_id").select("query_id", "skill_id", "score").repartition(
        "query_id").groupBy("query_id", "skill_id").agg(F.sum("score").alias("score"))


def neighbour_grid(neighbours: DataFrame, edges: DataFrame, grid: Sequence[int]) -> DataFrame:
    """`neighbour_skills` for every k of a grid from one ranked neighbour table with `rank`."""
    sizes = F.explode(F.filter(F.array(*[F.lit(k) for k in grid]), lambda k: F.col("rank") <= k))
    expanded = neighbours.select("query_id", "job_id", "score", sizes.alias("k"))
    return edges.join(expanded, "job_id").groupBy("k", "query_id", "skill_id").agg(F.sum("score").alias("score"))


def occlusion_adamic(queries: DataFrame, best: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Score lost on each ranked posting when one owned skill is removed; additive, so it is the skill's own term."""
    terms = queries.join(stats.select("skill_id", "inv"), "skill_id")
    return best.select("query_id", "job_id").join(terms, "query_id").join(
        edges.withColumn("listed", F.lit(True)), ["job_id", "skill_id"], "left"
    ).select("query_id", "job_id", "skill_id", F.when(F.col("listed"), F.col("inv")).otherwise(0.0).alias("drop"))


def occlusion_tfidf(queries: DataFrame, best: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Score lost on each ranked posting when one owned skill is removed and the profile is normalised again."""
    square = F.col("idf") * F.col("idf")
    terms = queries.join(stats.select("skill_id", "idf"), "skill_id").withColumn("sq", square)
    norms = terms.groupBy("query_id").agg(F.sum("sq").alias("q2"))
    listed = edges.join(best.select("job_id").distinct(), "job_id", "left_semi")
    job_norms = listed.join(stats.select("skill_id", "idf"), "skill_id").groupBy("job_id").agg(
        F.sqrt(F.sum(square)).alias("norm"))
    rows = (
        best.select("query_id", "job_id", "score").join(terms, "query_id").join(norms, "query_id").join(job_norms, "job_id")
        .join(listed.withColumn("listed", F.lit(1.0)), ["job_id", "skill_id"], "left")
    )
    dot = F.col("score") * F.col("norm") * F.sqrt("q2")
    rest = dot - F.coalesce("listed", F.lit(0.0)) * F.col("sq")
    without = F.when(F.col("q2") - F.col("sq") > 1e-9,
                     F.try_divide(rest, F.sqrt(F.col("q2") - F.col("sq")) * F.col("norm"))).otherwise(0.0)
    return rows.select("query_id", "job_id", "skill_id", (F.col("score") - without).alias("drop"))


def role_scores(scores: DataFrame, postings: DataFrame, depth: int = 500, k: int = 8) -> DataFrame:
    """Occupations by the summed scores of each query's best `depth` postings."""
    best = top_postings(scores, depth).join(postings.select("job_id", "occupation"), "job_id")
    roles = best.filter(F.col("occupation").isNotNull()).groupBy("query_id", "occupation").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("in_best"))
    return best_per_group(roles, ["query_id"], [*stable(), F.asc("occupation")], k)


def target_group(scores: DataFrame, postings: DataFrame, depth: int = 200) -> DataFrame:
    """Most common occupation group among each query's best `depth` postings; the smaller name wins ties."""
    best = top_postings(scores, depth).join(postings.select("job_id", "isco2"), "job_id")
    votes = best.groupBy("query_id", "isco2").agg(F.count(F.lit(1)).alias("votes"))
    return best_per_group(votes, ["query_id"], [F.desc("votes"), F.asc("isco2")], 1).drop("rank")


def explain_matches(best: DataFrame, queries: DataFrame, edges: DataFrame, stats: DataFrame, missing: int = 8) -> DataFrame:
    """Matched skills and the heaviest missing skills of every ranked posting, as arrays by descending weight."""
    owned = queries.withColumn("owned", F.lit(True))
    rows = (
        edges.join(best.select("query_id", "job_id"), "job_id").join(stats.select("skill_id", "w"), "skill_id")
        .join(owned, ["query_id", "skill_id"], "left")
    )
    item = F.struct((-F.col("w")).alias("order"), F.col("skill_id"))
    lists = rows.groupBy("query_id", "job_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("owned"), item))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("owned").isNull(), item))).alias("x"),
    )
    return lists.select(
        "query_id", "job_id", F.transform("m", lambda s: s["skill_id"]).alias("matched"),
        F.transform(F.slice("x", 1, missing), lambda s: s["skill_id"]).alias("missing"))


def contributions(best: DataFrame, queries: DataFrame, edges: DataFrame, stats: DataFrame, k: int = 6) -> DataFrame:
    """The k owned skills whose removal costs a ranked posting most: (query_id, job_id, place, skill_id, drop)."""
    drops = occlusion_tfidf(queries, best, edges, stats).withColumn("drop", F.round("drop", 5))
    return best_per_group(drops, ["query_id", "job_id"], [F.desc("drop"), F.asc("skill_id")], k, "place")


def evidence_paths(matches: DataFrame, postings: DataFrame, sources: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Why a posting was matched, step by step: (query_id, job_id, path, step, kind, label).

    A path starts at one of the first k skills of `matches(query_id, job_id, matched)`, or at the text it was found in where
    `sources(query_id, skill_id, source_text)` has one, and leads over the posting to its occupation, if it has one.
    """
    starts = matches.select("query_id", "job_id", F.posexplode(F.slice("matched", 1, k)).alias("path", "skill_id"))
    if sources is None:
        starts = starts.withColumn("source_text", F.lit(None).cast("string"))
    else:
        starts = starts.join(sources.select("query_id", "skill_id", "source_text"), ["query_id", "skill_id"], "left")
    named = starts.join(postings.select("job_id", "title", "company", "occupation"), "job_id")
    step = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    steps = F.filter(F.array(
        step("input", F.col("source_text")), step("skill", F.col("skill_id")),
        step("posting", F.concat("title", F.lit(" ("), "company", F.lit(")"))), step("occupation", F.col("occupation"))),
        lambda s: s["label"].isNotNull())
    return named.select("query_id", "job_id", "path", F.posexplode(steps).alias("step", "_s")).select(
        "query_id", "job_id", "path", "step", "_s.kind", "_s.label")


def role_skills(
    roles: DataFrame, queries: DataFrame, edges: DataFrame | None, postings: DataFrame | None, requirements: DataFrame, missing: int = 6, owned: int = 8,
    demand: DataFrame | None = None
) -> DataFrame:
    """Per ranked role the skills its postings list most often that the profile lacks, and the essential ones it has, as arrays.

    `roles(query_id, occupation)`, `requirements(occupation, skill_id, relation)`. Skills are counted once per occupation; with
    `demand(occupation, skill_id, postings)` they are counted already, and edges and postings are not read.
    """
    wanted = roles.select("query_id", "occupation")
    counts = demand
    if demand is None:
        counts = edges.join(postings.select("job_id", "occupation").join(wanted.select("occupation").distinct(), "occupation"), "job_id").groupBy(
            "occupation", "skill_id").agg(F.count(F.lit(1)).alias("postings"))
    lacking = wanted.join(counts, "occupation").join(queries, ["query_id", "skill_id"], "left_anti")
    best = best_per_group(lacking, ["query_id", "occupation"], [F.desc("postings"), F.asc("skill_id")], missing)
    has = wanted.join(requirements.filter("relation = 'essential'"), "occupation").join(queries, ["query_id", "skill_id"])
    held = best_per_group(has, ["query_id", "occupation"], [F.asc("skill_id")], owned)

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("query_id", "occupation").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill_id"))), lambda s: s["skill_id"]).alias(name))

    none = F.array().cast("array<string>")
    return wanted.join(listed(best, "missing"), ["query_id", "occupation"], "left").join(
        listed(held, "essential"), ["query_id", "occupation"], "left").withColumns(
        {"missing": F.coalesce("missing", none), "essential": F.coalesce("essential", none)})


def best_candidates(requests: DataFrame, candidates: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """The `limit` best candidates per job description with the requested skills they have and lack, heaviest first."""
    best = best_per_group(rank_candidates(requests, candidates, stats), ["query_id"], [F.desc("score"), F.asc("candidate_id")], limit)
    wanted = query_terms(requests, stats, "w")
    has = candidates.withColumn("has", F.lit(True))
    rows = best.select("query_id", "candidate_id").join(wanted, "query_id").join(has, ["candidate_id", "skill_id"], "left")
    item = F.struct((-F.col("w")).alias("order"), F.col("skill_id"))
    lists = rows.groupBy("query_id", "candidate_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("has"), item))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("has").isNull(), item))).alias("x"))
    return best.join(lists, ["query_id", "candidate_id"]).select(
        "query_id", "rank", "candidate_id", "score", "coverage", F.transform("m", lambda s: s["skill_id"]).alias("matched"),
        F.transform("x", lambda s: s["skill_id"]).alias("missing"))


def rank_candidates(requests: DataFrame, candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Candidates per job description: weighted coverage plus 0.01·ln(1 + skills owned).

    `requests(query_id, skill_id)`, `candidates(candidate_id, skill_id)`. Candidates without a requested skill are left
    out; their coverage is 0.
    """
    wanted = query_terms(requests, stats, "w")
    totals = wanted.groupBy("query_id").agg(F.sum("w").alias("total"))
    sizes = candidates.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_skills"))
    covered = candidates.join(wanted, "skill_id").groupBy("query_id", "candidate_id").agg(F.sum("w").alias("covered"))
    coverage = F.col("covered") / F.col("total")
    return covered.join(sizes, "candidate_id").join(totals, "query_id").select(
        "query_id", "candidate_id", F.round(coverage, 4).alias("coverage"),
        F.round(coverage + 0.01 * F.log1p(F.col("n_skills").cast("double")), 5).alias("score"))


def curriculum(scopes: DataFrame, edges: DataFrame, syllabus: DataFrame, top_n: int = 40, low_share: float = 0.002) -> DataFrame:
    """Demand standing of skills per scope: covered or missing among the `top_n`, or taught but in low demand.

    `scopes(scope, job_id)`, `syllabus(scope, skill_id)`.
    """
    sizes = scopes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    counts = edges.join(scopes, "job_id").groupBy("scope", "skill_id").agg(F.count(F.lit(1)).alias("postings"))
    taught = syllabus.withColumn("taught", F.lit(True))
    ranked = best_per_group(counts, ["scope"], [F.desc("postings"), F.asc("skill_id")], top_n).join(
        taught, ["scope", "skill_id"], "left").join(sizes, "scope").select(
        "scope", "skill_id", "postings", F.round(F.col("postings") / F.col("n"), 4).alias("share"),
        F.when(F.col("taught"), "covered").otherwise("missing").alias("standing"))
    low = syllabus.join(counts, ["scope", "skill_id"], "left").join(sizes, "scope").withColumn(
        "postings", F.coalesce("postings", F.lit(0))).filter(F.col("postings") / F.col("n") < low_share)
    return ranked.unionByName(low.select(
        "scope", "skill_id", "postings", F.round(F.col("postings") / F.col("n"), 4).alias("share"),
        F.lit("low_demand").alias("standing")))


def curriculum_coverage(standing: DataFrame) -> DataFrame:
    """Demand-weighted share of the top skills that the syllabus teaches."""
    top = standing.filter(F.col("standing") != "low_demand")
    hit = F.sum(F.when(F.col("standing") == "covered", F.col("postings")).otherwise(0))
    return top.groupBy("scope").agg(F.round(hit / F.sum("postings"), 4).alias("coverage"), F.count(F.lit(1)).alias("top_skills"))


def overlap_share(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of a posting's skills that a profile owns, unweighted."""
    sizes = edges.groupBy("job_id").agg(F.count(F.lit(1)).alias("required"))
    hits = edges.join(queries, "skill_id").groupBy("query_id", "job_id").agg(F.count(F.lit(1)).alias("overlap"))
    return hits.join(sizes, "job_id").select(
        "query_id", "job_id", "overlap", "required", (F.col("overlap") / F.col("required")).alias("score"))


def mean_vectors(owners: DataFrame, owner: str, vectors: DataFrame) -> DataFrame:
    """L2-normalised mean of the vectors of an owner's skills; `vectors(skill_id, vector)`.

    The mean is a plain average per (owner, dimension), so it combines map-side.
    """
    cells = owners.join(vectors, "skill_id").select(owner, F.posexplode("vector").alias("d", "x"))
    means = cells.groupBy(owner, "d").agg(F.avg("x").alias("x"))
    packed = means.groupBy(owner).agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("mean"))
    return packed.select(owner, F.transform("mean", lambda x: x / F.col("norm")).alias("vector"))


def propagate(edges: DataFrame, signal: DataFrame, layers: int = 3) -> DataFrame:
    """Mean over layers 0..L of a signal on skills under symmetric-normalised propagation through postings.

    `signal(skill_id, dim, value)`; one layer goes skill → posting or posting → skill along every edge. Each layer is
    written out so that plans stay short and a lost executor only repeats one layer.
    """
    by_job = Window.partitionBy("job_id")
    degrees = edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("ds"))
    links = cut(
        edges.withColumn("dj", F.count(F.lit(1)).over(by_job)).join(degrees, "skill_id")
        .select("job_id", "skill_id", (1 / F.sqrt(F.col("dj") * F.col("ds"))).alias("a")))
    skills = signal.select("skill_id", "dim", F.col("value").cast("double").alias("value"))
    total, jobs = skills, None
    for _ in range(layers):
        to_jobs = links.join(skills, "skill_id").groupBy("job_id", "dim").agg(
            F.sum(F.col("a") * F.col("value")).alias("value"))
        to_skills = None if jobs is None else links.join(jobs, "job_id").groupBy("skill_id", "dim").agg(
            F.sum(F.col("a") * F.col("value")).alias("value"))
        jobs = cut(to_jobs)
        skills = jobs.select(F.lit("").alias("skill_id"), "dim", "value").limit(0) if to_skills is None else cut(to_skills)
        total = total.unionByName(skills)
    return total.groupBy("skill_id", "dim").agg((F.sum("value") / (layers + 1)).alias("value"))


def latent_scores(edges: DataFrame, queries: DataFrame, k: int = 10, rank: int = 8, seed: int = 17) -> DataFrame:
    """Implicit-feedback matrix factorisation over the known edges; new profiles are folded in from item factors."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.recommendation import ALS

    users = dense_numbers(edges, "job_id", "user", (1 << 31) - 1)
    indexer = StringIndexer(inputCol="skill_id", outputCol="item", stringOrderType="alphabetAsc").fit(edges)
    coded = indexer.transform(edges).join(users, "job_id").select(
        F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"),
        F.lit(1.0).alias("rating"))
    model = ALS(implicitPrefs=True, rank=rank, maxIter=5, seed=seed, userCol="user", itemCol="item", ratingCol="rating").fit(coded)
    names = indexer.transform(edges.select("skill_id").distinct()).select("skill_id", F.col("item").cast("int").alias("id"))
    degrees = edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("deg"))
    items = model.itemFactors.join(names, "id").join(degrees, "skill_id").select("skill_id", "deg", F.col("features").alias("vector"))
    sizes = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    folded = (
        queries.join(items, "skill_id").join(sizes, "query_id")
        .select("query_id", F.posexplode("vector").alias("d", "x"), F.sqrt(F.col("deg") * F.col("size")).alias("scale"))
        .groupBy("query_id", "d").agg(F.sum(F.col("x") / F.col("scale")).alias("q"))
    )
    profile = folded.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "q"))), lambda c: c["q"]).alias("vector"))
    return nearest(unit(profile), unit(items), k, item="skill_id")
