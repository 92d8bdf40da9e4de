"""Profiles meet postings by the two largest terms that they share, in bands where the rest can still reach the score."""

import random

from pyspark.sql import functions as F

from talentgrid.functions.distributed import item_pairs
from talentgrid.operators import recommend as rec
from talentgrid.operators import topk


def test_pairs_that_cannot_reach_the_score_make_no_candidates(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(j, f"s{s:02}") for j in range(1500) for s in rng.sample(range(12), rng.randint(1, 6))], "job_id long, skill_id string").cache()
    queries = spark.createDataFrame([(f"q{i}", f"s{s:02}") for i in range(12) for s in rng.sample(range(12), rng.randint(2, 4))], "query_id string, skill_id string")
    stats = rec.skill_statistics(edges)
    terms = topk.tfidf_terms(queries, stats)
    placed = topk.placed_edges(edges, topk.posting_scale(edges, stats)).cache()
    best = topk._kth_scores(placed, terms, 5)
    found = topk.paired_candidates(placed, terms, best).cache()
    full = topk._scored(edges.join(queries, "skill_id").select("query_id", "job_id").distinct(), placed, terms).join(best, "query_id")
    reaching = full.filter("score >= least").select("query_id", "job_id")
    assert reaching.exceptAll(found).isEmpty() and found.groupBy("query_id", "job_id").count().filter("count > 1").isEmpty()
    shared = edges.join(queries, "skill_id").groupBy("query_id", "job_id").count().filter("count > 1").count()
    assert found.count() < shared
    least = terms.join(best, "query_id").select("query_id", "skill_id", "t", "least")
    bands = sorted(r.band for r in placed.select("band").distinct().collect())
    pairs = least.alias("x").join(least.alias("y"), "query_id").filter("x.skill_id < y.skill_id").count()
    leading = topk._leading_pairs(least, bands).cache()
    assert leading.count() < 0.95 * pairs * len(bands) and leading.filter("a >= b").isEmpty()
    want = sorted((r.query_id, r["rank"], r.job_id, round(r.score, 9)) for r in rec.top_postings(rec.tfidf_cosine(queries, edges, stats), 5).collect())
    assert sorted((r.query_id, r["rank"], r.job_id, round(r.score, 9)) for r in topk.top_tfidf(queries, edges, stats, 5, paired=True).collect()) == want


def test_short_sets_are_paired_where_they_are(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, list("defghi"))], "owner int, items array<string>")
    got = {tuple(r) for r in item_pairs(sets, ["owner"], slice_size=4).collect()}
    assert got == {(1, "a", "b"), (1, "a", "c"), (1, "b", "c")} | {(3, x, y) for x in "defghi" for y in "defghi" if x < y}
    assert item_pairs(sets.filter(F.size("items") < 4), ["owner"], slice_size=4).count() == 3
