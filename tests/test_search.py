"""Pruned searches against plain ones: top postings, best plans, names in common, nearest vectors."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.functions import vectors as vec
from talentgrid.operators import coverage as cov
from talentgrid.operators import geography as geo
from talentgrid.operators import recommend as rec
from talentgrid.operators import topk
from talentgrid.operators import workforce as wf


def market(spark, jobs=3000, skills=300, seed=1):
    """Postings whose skills follow a steep popularity, and profiles that mix common and rare ones."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(skills)]
    edges = [(j, f"s{s:03d}") for j in range(jobs) for s in set(rng.choices(range(skills), weights, k=rng.randint(1, 12)))]
    profiles = [(f"q{q}", f"s{s:03d}") for q in range(12) for s in set(rng.choices(range(skills), weights, k=4)) | set(rng.sample(range(100, skills), 4))]
    edges = spark.createDataFrame(edges, "job_id long, skill_id string").persist()
    return spark.createDataFrame(profiles + [("lone", "none")], "query_id string, skill_id string"), edges, rec.skill_statistics(edges)


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_top_postings_are_those_of_all_scores(spark, k):
    queries, edges, stats = market(spark)
    for pruned, whole in ((topk.top_tfidf, rec.tfidf_cosine), (topk.top_adamic_adar, rec.adamic_adar)):
        rows = lambda df: sorted((r.query_id, r["rank"], r.job_id, round(r.score, 9)) for r in df.collect())
        assert rows(pruned(queries, edges, stats, k)) == rows(rec.top_postings(whole(queries, edges, stats), k))


def test_few_shared_pairs_become_candidates(spark):
    queries, edges, stats = market(spark)
    shared = edges.join(queries, "skill_id").select("query_id", "job_id").distinct().count()
    terms = topk.tfidf_terms(queries, stats)
    cosine = topk.candidates(topk.placed_edges(edges, topk.posting_scale(edges, stats)), terms, 10).count()
    additive = topk.candidates(topk.placed_edges(edges), queries.join(stats, "skill_id").select("query_id", "skill_id", F.col("inv").alias("t"), "df"), 10).count()
    assert cosine < shared / 4 and additive < shared / 4


def test_best_plans_are_those_of_all_subsets(spark):
    rng = random.Random(7)
    edges, pool, have, weights = [], [], [], [(f"s{s:02d}", rng.randint(1, 9)) for s in range(26)]
    for i in range(6):
        have += [(f"u{i}", f"s{s:02d}") for s in rng.sample(range(26), 3)]
        for j in range(40):
            job = 100 * i + j
            pool.append((f"u{i}", job, rng.choice([1, 1, 2])))
            edges += [(job, f"s{s:02d}") for s in rng.sample(range(26), rng.randint(2, 8))]
        edges += [(900 + i, "s00")]
        pool.append((f"u{i}", 900 + i, 1))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (pool, "instance_id string, job_id long, value long"), (have, "instance_id string, skill_id string"), (edges, "job_id long, skill_id string"),
        (weights, "skill_id string, w long"))]
    packed = cov.pack_pool(*frames, tau_pct=60)
    w, own = dict(weights), {i: {s for u, s in have if u == i} for i, _ in have}
    listed = {}
    for job, s in edges:
        listed.setdefault(job, set()).add(s)
    for k in (1, 2, 3):
        got = {r.instance_id: (r.F, r.skills, r.proven) for r in cov.best_subset(packed, k).collect()}
        for i, owned in own.items():
            jobs = [(listed[j], v) for u, j, v in pool if u == i]
            missing = sorted(set().union(*(s for s, _ in jobs)) - owned)
            assert len(missing) > 16

            def reach(plan):
                return sum(v for s, v in jobs if 100 * sum(w[x] for x in s & (owned | set(plan))) >= 60 * sum(w[x] for x in s))

            best = min(((-reach(p), len(p), p) for n in range(k + 1) for p in itertools.combinations(missing, n)))
            assert got[i] == (-best[0], list(best[2]), True)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_length_over_words(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("abc", "abc"), ("né😀x", "n😀éx"), ("a" * 62, "a" * 62), ("a" * 63, "a" * 124), ("ab" * 100, "ba" * 90)]
    for n in (5, 61, 62, 63, 124, 125, 200):
        for _ in range(12):
            a = "".join(rng.choice("abcdefg h") for _ in range(n))
            b = "".join(c if rng.random() < 0.8 else rng.choice("abcxyz") for c in a if rng.random() < 0.9)
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == common(r.a, r.b) for r in got)


def test_states_and_cities_go_by_usual_names(spark):
    rows = spark.createDataFrame([("  Jammu &  kashmir",), ("Goa ",), ("old goa",), ("OLD  GOA",), (None,)], "state string")
    aliases = spark.createDataFrame([("Old Goa", "Goa"), ("Old Goa", "North Goa")], "spelling string, name string")
    got = [r.state for r in geo.with_canonical_state(rows, "state", aliases).collect()]
    assert sorted(got, key=str) == sorted(["Jammu and Kashmir", "Goa", "North Goa", "North Goa", None], key=str)
    supply = wf.supply_table(
        spark.createDataFrame([("Goa", 3), (" goa-land", 4)], "state string, graduates long"), spark.createDataFrame([("GOA-LAND", 1.5)], "state string, youth_ur double"),
        spellings=spark.createDataFrame([("goa-land", "Goa")], "spelling string, name string")).collect()
    assert [tuple(r) for r in supply] == [("Goa", 7, 1.5)]
    cities = spark.createDataFrame([("Bengaluru", "Karnataka"), ("Pune", "Goa"), (None, "Goa")], "city string, state string")
    tiers = spark.createDataFrame([("Bangalore", 1, ""), ("Poona", 2, "Maharashtra")], "city string, tier int, tier_state string")
    names = spark.createDataFrame([("bangalore", " Bengaluru ", ""), ("poona", "Pune", "")], "alias string, city string, lookup string")
    assert {r.city: r.tier for r in geo.with_tier(cities, tiers, names).collect()} == {"Bengaluru": 1, "Pune": 3, None: None}
    assert {r.city: r.tier for r in geo.with_tier(cities, tiers).collect()} == {"Bengaluru": 3, "Pune": 3, None: None}


def test_nearest_by_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 4
    points = (centres[:, None] + 0.1 * rng.standard_normal((20, 200, 16))).reshape(-1, 16)
    items = [(int(i // 3), [float(x) for x in v]) for i, v in enumerate(points)] + [(5000, [0.0] * 16)]
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([points[::97] * 0.3, rng.standard_normal((5, 16))]))] + [(900, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    table = spark.createDataFrame(items, "item_id long, vector array<double>")
    owners, matrix = np.array([i for i, _ in items]), np.array([v for _, v in items])
    for pivots in (1, 20, 64):
        got = {}
        for r in vec.nearest(queries, table, 5, pivots=pivots).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.item_id, round(r.score, 7)))
        for i, v in asked:
            pooled = {}
            for o, s in zip(owners.tolist(), (matrix @ np.array(v)).tolist()):
                pooled[o] = max(s, pooled.get(o, -math.inf))
            best = sorted(pooled.items(), key=lambda p: (-round(p[1], 9), p[0]))[:5]
            assert sorted(got[i]) == [(n + 1, o, round(s, 7)) for n, (o, s) in enumerate(best)]
    assert vec.nearest(queries, table.limit(0), 5).collect() == []


def test_cells_out_of_reach_are_not_met(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 32))
    points = (centres[:, None] + 0.05 * rng.standard_normal((30, 50, 32))).reshape(-1, 32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    cells = vec.Cells(points[::50])
    cell, far, angle, length = cells.nearest(points)
    by_cell = lambda x: np.array([x[cell == c].max(initial=0) for c in range(30)])
    reach = vec.Cells(points[::50], by_cell(far), by_cell(angle), by_cell(length))
    queries = spark.createDataFrame([(i, [float(x) for x in v], 0.9) for i, v in enumerate(points[::7])], "id long, vector array<double>, least double")
    sizes = np.bincount(cell, minlength=30).astype(float)
    first = vec._meeting_cells(queries, reach, sizes, 5, True).count()
    rest = vec._meeting_cells(queries, reach, sizes, 5, False).count()
    assert first + rest < queries.count() * 30 / 10
    best = (points[::7] @ points.T)
    bounds = reach.bounds(points[::7])
    assert all((bounds[:, c] >= best[:, cell == c].max(1) - 1e-9).all() for c in range(30))


def test_fit_of_given_pairs(spark):
    queries, edges, stats = market(spark, 200, 140)
    whole = rec.coverage_fit(queries, edges, stats)
    some = whole.filter("job_id % 3 = 0")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "job_id", "covered", "total", "fit", "eligible").collect())
    assert rows(rec.fit_of(some, queries, edges, stats)) == rows(some)


def test_candidates_and_evidence(spark):
    requests = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query_id string, skill_id string")
    owned = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "x"), (3, "a"), (3, "b"), (4, "x")], "candidate_id long, skill_id string")
    stats = spark.createDataFrame([("a", 5), ("b", 7), ("c", 3), ("x", 1)], "skill_id string, w long")
    got = [(r["rank"], r.candidate_id, r.coverage, r.matched, r.missing) for r in rec.best_candidates(requests, owned, stats, 2).collect()]
    assert sorted(got) == [(1, 1, 0.8, ["b", "a"], ["c"]), (2, 3, 0.8, ["b", "a"], ["c"])]
    matches = spark.createDataFrame([("q", 7, ["b", "a", "c", "d"]), ("q", 8, [])], "query_id string, job_id long, matched array<string>")
    postings = spark.createDataFrame([(7, "Clerk", "Firm", None), (8, "T", "C", "o")], "job_id long, title string, company string, occupation string")
    sources = spark.createDataFrame([("q", "a", "I know a")], "query_id string, skill_id string, source_text string")
    paths = sorted(tuple(r)[2:] for r in rec.evidence_paths(matches, postings, sources).collect())
    assert paths == [(0, 0, "skill", "b"), (0, 1, "posting", "Clerk (Firm)"), (1, 0, "input", "I know a"), (1, 1, "skill", "a"), (1, 2, "posting", "Clerk (Firm)"),
                     (2, 0, "skill", "c"), (2, 1, "posting", "Clerk (Firm)")]


def test_runs_with_the_same_skills_are_measured_once_and_against_postings_they_touch(spark):
    rng = random.Random(11)
    skills = [f"s{i}" for i in range(9)]
    rows = []
    for job in range(60):
        own = sorted(rng.sample(skills, rng.randint(1, 4)))
        missing = [(s, 10 + int(s[1])) for s in own]
        base = rng.choice([0, 15])
        rows.append(("i", job, 1, base, 60 * (base + sum(w for _, w in missing)), missing))
    packed = spark.createDataFrame(rows, "instance_id string, job_id long, value long, base long, need long, missing array<struct<s:string,w:long>>")
    offers, plain = cov._set_pool(packed)
    runs = spark.createDataFrame([("i", "r1", ["s1", "s2"], 1.0), ("i", "r2", ["s2", "s1"], 1.0), ("i", "r3", ["s8"], 0.5)],
                                 "instance_id string, run_id string, chosen array<string>, spent double")
    sets = cov._numbered_sets(runs)
    assert sets.count() == 2
    met = {(r.set_id, tuple(r.chosen)): r.n for r in cov._touched(offers, sets).groupBy("set_id", "chosen").agg(F.sum("value").alias("n")).collect()}
    for (_, chosen), n in met.items():
        assert n == sum(any(s in chosen for s, _ in r[5]) and 100 * r[3] < r[4] for r in rows) < 60
    key = F.array_join(F.array_sort("chosen"), ",").alias("key")
    names = sets.select("set_id", key)
    new = {(r.key, r.skill_id): (r.gain_f, round(r.gain_g, 9)) for r in cov._set_gains(offers, plain, sets).join(names, "set_id").collect()}
    old = {(r.key, r.skill_id): (r.gain_f, round(r.gain_g, 9)) for r in cov.gains(packed, runs).join(runs.select("run_id", key), "run_id").collect()}
    assert new == old


def test_pairs_of_skills_find_the_best_postings_and_equal_profiles_are_one(spark):
    from talentgrid.operators import evaluation as ev

    rng = random.Random(5)
    edges = spark.createDataFrame([(j, f"s{s}") for j in range(400) for s in rng.sample(range(25), rng.randint(1, 6))], "job_id long, skill_id string").cache()
    sets = [rng.sample(range(25), rng.randint(1, 4)) for _ in range(15)]
    queries = spark.createDataFrame([(f"q{i}", f"s{s}") for i in range(45) for s in sets[i % 15]], "query_id string, skill_id string")
    profiles, members = ev.equal_profiles(queries)
    assert profiles.select("query_id").distinct().count() == len({tuple(sorted(s)) for s in sets}) and members.count() == 45
    stats = rec.skill_statistics(edges)
    listed = lambda found: sorted((r["rank"], r.query_id, r.job_id, round(r.score, 9)) for r in found.collect())
    want = listed(rec.top_postings(rec.tfidf_cosine(queries, edges, stats), 12))
    assert listed(topk.top_tfidf(queries, edges, stats, 12, paired=True)) == want


def test_of_equal_vectors_only_the_first_owners_are_compared(spark):
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    items = spark.createDataFrame([(f"u{i:03}", vectors[i % 3]) for i in range(90)], "item_id string, vector array<double>")
    assert vec.first_owners(items.select(F.col("item_id").alias("owner"), "vector"), 2).count() == 6
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.item_id) for r in vec.nearest(queries, items, 2).collect())
    assert got == [("a", 1, "u000"), ("a", 2, "u003"), ("b", 1, "u002"), ("b", 2, "u005")]
