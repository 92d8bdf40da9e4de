"""Operators on small hand-made tables."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.functions import text as tx
from talentgrid.functions.distributed import cumulative, exact_quantiles, item_pairs
from talentgrid.functions.vectors import nearest
from talentgrid.operators import cleaning, coverage, extraction, geography, linking, ordinal, recommend
from talentgrid.operators.grouping import connected_groups
from talentgrid.sources import readers, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("o")).first()["o"]


def test_tags(spark):
    raw = "Rust;lang ,  MS   Word,, rust;lang,-Kafka;, .htaccess ,A/B Testing-"
    assert one(spark, tx.split_tags(F.col("v")), raw) == ["rust;lang", "ms word", "kafka", ".htaccess", "a/b testing"]
    assert one(spark, tx.split_tags(F.col("v")), None) == []


@pytest.mark.parametrize("text,age", [("12 Days Ago", 12), ("45+ Days Ago", 45), ("Just Now", 0), ("Today", 0), ("next spring", None), ("", None)])
def test_upload_age(spark, text, age):
    assert one(spark, num.days_ago(F.col("v")), text) == age


@pytest.mark.parametrize("code,day", [("150324777777", "2024-03-15"), ("290224000009", "2024-02-29"), ("310224000009", None), ("15032", None)])
def test_id_date(spark, code, day):
    assert one(spark, num.posting_date(F.col("v")).cast("string"), code) == day


@pytest.mark.parametrize("years,band", [(0, "0-1"), (1, "0-1"), (2, "1-3"), (3, "3-6"), (7, "6-10"), (12, "10+"), (None, None)])
def test_experience_band(spark, years, band):
    assert one(spark, num.experience_band(F.col("v")), years, "int") == band


@pytest.mark.parametrize("low,high,currency,policy,flag,mid", [
    ("0", "0", "INR", "exclude", "not_disclosed", None), ("300000", "0", "INR", "exclude", "ok", 300000), ("0", "500000", "INR", "exclude", "ok", 500000),
    ("900000", "600000", "INR", "exclude", "ok", 750000), ("786", "786", "INR", "exclude", "implausible", None),
    ("300000", "90000000", "INR", "exclude", "implausible", None), ("10000", "15000", "USD", "exclude", "currency_suspect", None),
    ("10000", "20000", "USD", "convert", "converted_from_usd", 1200000)])
def test_pay(spark, low, high, currency, policy, flag, mid):
    df = spark.createDataFrame([(low, high, currency)], "minimumSalary string, maximumSalary string, currency string")
    row = cleaning.with_pay(df, policy, 80.0).first()
    assert (row["salary_flag"], row["salary_mid_inr"]) == (flag, mid)


def test_near_duplicates(spark):
    rows = [(0, "1", "Dev", "Acme", "Python,SQL"), (1, "1", "Dev", "Acme", "Python,SQL"), (2, "2", "dev!", "ACME ", "SQL,Python"), (3, "3", "Dev", "Other", "SQL")]
    df = spark.createDataFrame(rows, "row_no long, jobId string, title string, companyName string, tagsAndSkills string")
    groups = {r["jobId"]: r["dup_group_id"] for r in cleaning.tidy(df).collect()}
    assert len(groups) == 3 and groups["1"] == groups["2"] != groups["3"]


@pytest.mark.parametrize("text,tokens,mode", [
    ("hybrid: Surat", ["Surat"], "hybrid"), ("Nagpur (Ring Road) ", ["Nagpur"], "onsite"), ("Kochi|Madurai;Salem", ["Kochi", "Madurai", "Salem"], "onsite"),
    ("Remote / remote", [], "remote"), ("Salem and Remote", ["Salem"], "remote"), (" , ", [], "onsite"), (None, [], "onsite")])
def test_locations(spark, text, tokens, mode):
    parts = tx.location_parts(F.col("v"))
    assert one(spark, tx.location_tokens(parts), text) == tokens
    assert one(spark, tx.work_mode(parts), text) == mode


def test_token_resolution(spark):
    places = geography.gazetteer(spark.createDataFrame(
        [("Bengaluru", "Bengaluru", "Bangalore,बेंगलुरु", "Karnataka", 8_000_000, 12.9, 77.6), ("Mysore", "Mysore", "", "Karnataka", 900_000, 12.3, 76.6),
         ("Thiruvananthapuram", "Thiruvananthapuram", "", "Kerala", 700_000, 8.5, 76.9), ("Smallville", "Smallville", "Tinytown", "Kerala", 10_000, 8.0, 76.0)],
        "name string, ascii string, alternates string, state string, population long, lat double, lon double"))
    aliases = spark.createDataFrame([("Mysuru", "Mysuru", "Mysore")], "alias string, city string, lookup string")
    states = spark.createDataFrame([("Kerala",), ("Goa",)], "state string")
    tokens = spark.createDataFrame([(t,) for t in ("Bangalore", "Mysuru", "Dubai", "North Goa", "Thiruvanantapuram", "Smallvile", "Tinytown", "Mysor")], "token string")
    got = {r["token"]: (r["matched_by"], r["city"], r["state"]) for r in geography.resolve_tokens(tokens, places, aliases, states).collect()}
    assert got["Bangalore"] == ("exact", "Bengaluru", "Karnataka")
    assert got["Mysuru"] == ("alias", "Mysuru", "Karnataka")
    assert got["Dubai"][0] == "foreign" and got["North Goa"] == ("state_only", None, "Goa")
    assert got["Thiruvanantapuram"] == ("fuzzy", "Thiruvananthapuram", "Kerala")
    assert got["Smallvile"][0] is None and got["Tinytown"][0] is None and got["Mysor"][0] is None


def test_fuzzy_join_finds_every_pair(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 22))) for _ in range(60)]
    keys = set()
    for name in names:
        chars = list(name)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(chars))
            chars[i:i + 1] = rng.choice([[], [chars[i], "x"], ["y"]])
        keys.add("".join(chars))

    def ratio(a, b):
        best = lru_cache(None)(lambda i, j: 0 if i == len(a) or j == len(b) else 1 + best(i + 1, j + 1) if a[i] == b[j]
                               else max(best(i + 1, j), best(i, j + 1)))
        return 2 * best(0, 0) / (len(a) + len(b))

    expected = {k for k in keys if max(ratio(k, n) for n in names) >= 0.92}
    places = spark.createDataFrame([(n, 50_000) for n in set(names)], "key string, population long")
    found = geography.fuzzy_matches(spark.createDataFrame([(k,) for k in keys], "key string"), places)
    assert {r["key"] for r in found.collect()} == expected and expected


def test_exact_labels_prefer_better_kinds(spark):
    concepts = spark.createDataFrame(
        [("u1", "Python (programming)", ["snake"]), ("u2", "Cooking", ["python"]), ("u3", "SQL", ["query"]), ("u4", "Search", ["query"])],
        "uri string, preferred string, alternates array<string>")
    texts = spark.createDataFrame([("python",), ("Query",), ("sql",), ("unknown",)], "text string")
    got = dict(linking.exact_links(texts, linking.concept_labels(concepts)).select("text", "uri").collect())
    assert got == {"python": "u1", "Query": None, "sql": "u3", "unknown": None}


def test_title_reranking(spark):
    cands = spark.createDataFrame([(1, 0, "a", 0.80), (1, 1, "b", 0.78), (1, 2, "c", 0.60), (2, 0, "a", 1.0), (2, 1, "b", 0.99)],
                                  "job_id long, pos int, occupation string, score double")
    skills = spark.createDataFrame([(1, "s"), (1, "t"), (2, "s")], "job_id long, skill_id string")
    needs = spark.createDataFrame([("b", "s", "essential"), ("b", "t", "optional"), ("c", "s", "essential")], "occupation string, skill_id string, relation string")
    got = {r["job_id"]: (r["occupation"], r["overlap"]) for r in linking.rerank_titles(cands, skills, needs, 0.7).collect()}
    assert got == {1: ("b", 0.75), 2: ("a", 0.0)}


def _greedy_reference(jobs, weights, have, k, tau):
    def f(chosen):
        return sum(100 * sum(weights[s] for s in skills if s in have or s in chosen) >= tau * sum(weights[s] for s in skills) for skills in jobs.values())

    return f


def test_plans_against_brute_force(spark):
    from itertools import combinations

    rng = random.Random(11)
    skills = [f"s{i:02d}" for i in range(10)]
    weights = {s: rng.randint(1000, 5000) for s in skills}
    jobs = {j: set(rng.sample(skills, rng.randint(2, 5))) for j in range(40)}
    have = set(skills[:2])
    value = _greedy_reference(jobs, weights, have, 3, 60)
    pool = spark.createDataFrame([("i", j, 1) for j in jobs], "instance_id string, job_id long, value long")
    edges = spark.createDataFrame([(j, s) for j, ss in jobs.items() for s in ss], "job_id long, skill_id string")
    owned = spark.createDataFrame([("i", s) for s in have], "instance_id string, skill_id string")
    table = spark.createDataFrame(list(weights.items()), "skill_id string, w long")
    packed = coverage.pack_pool(pool, owned, edges, table).persist()
    assert coverage.objectives(packed).first()["F"] == value(set())
    best = max(value(set(c)) for r in range(4) for c in combinations(skills[2:], r))
    exact = coverage.best_subset(packed).first()
    assert exact["F"] == best == value(set(exact["skills"]))
    for order in (coverage.by_reach, coverage.by_smooth):
        plan = coverage.greedy(packed, 3, order)
        chosen = {r["skill_id"] for r in plan.collect()}
        reached = coverage.plan_value(packed, plan).first()["F"]
        assert reached == value(chosen) <= best
    costs = spark.createDataFrame([("i", s, 1.0 + i / 10) for i, s in enumerate(skills)], "instance_id string, skill_id string, cost double")
    run = coverage.budgeted(packed, costs, 3.0).first()
    assert run["spent"] <= 3.0 + 1e-9
    partial = coverage.budgeted_partial(packed, costs, 3.0, seed_pool=4).first()
    plain = coverage.objectives(coverage.with_runs(packed, coverage.budgeted(packed, costs, 3.0)), F.col("covered")).first()["G"]
    assert partial["G"] >= plain - 1e-9
    last = coverage.unlock_steps(packed, coverage.greedy(packed, 3)).filter("step IS NOT NULL").count()
    assert last == coverage.plan_value(packed, coverage.greedy(packed, 3)).first()["F"]
    packed.unpersist()


def test_integer_eligibility(spark):
    pool = spark.createDataFrame([("i", 1, 1)], "instance_id string, job_id long, value long")
    edges = spark.createDataFrame([(1, "a"), (1, "b")], "job_id long, skill_id string")
    have = spark.createDataFrame([("i", "a")], "instance_id string, skill_id string")
    weights = spark.createDataFrame([("a", 1000), ("b", 1000)], "skill_id string, w long")
    assert coverage.objectives(coverage.pack_pool(pool, have, edges, weights, 50)).first()["F"] == 1
    assert coverage.objectives(coverage.pack_pool(pool, have, edges, weights, 51)).first()["F"] == 0


def test_pairs_of_long_sets(spark):
    items = [f"i{n:03d}" for n in range(25)]
    sets = spark.createDataFrame([(1, items)], "job long, items array<string>")
    pairs = {tuple(r) for r in item_pairs(sets, slice_size=4).collect()}
    assert pairs == {(a, b) for i, a in enumerate(items) for b in items[i + 1:]}


def test_order_statistics(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([-5.0, 0.0, 1e6, rng.uniform(-100, 100)])) for k in "ab" for _ in range(101)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p77": 0.77}).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.77).alias("p77")).collect()}
    for k in "ab":
        assert got[k]["p10"] == pytest.approx(want[k]["p10"]) and got[k]["p77"] == pytest.approx(want[k]["p77"])
    first = cumulative(df, ["k"], "v").groupBy("k").agg(F.max(F.col("before") + F.col("n")).alias("end"), F.max("total").alias("t")).collect()
    assert all(r["end"] == r["t"] == 101 for r in first)


def test_nearest_matches_brute_force(spark):
    rng = random.Random(9)
    vec = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(30)}
    df = spark.createDataFrame(list(vec.items()), "id long, vector array<double>")
    got = nearest(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id"), 3, exclude_same=True)
    best = {}
    for r in got.collect():
        best.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for q, v in vec.items():
        order = sorted((-sum(a * c for a, c in zip(v, w)), i) for i, w in vec.items() if i != q)[:3]
        assert [i for _, i in sorted(best[q])] == [i for _, i in order]


def test_groups_are_transitive(spark):
    rows = [("r1", "a", "x"), ("r2", "a", "y"), ("r3", "b", "y"), ("r4", "c", ""), ("r5", "", "")]
    df = spark.createDataFrame(rows, "row_key string, id string, profile string")
    got = dict(connected_groups(df, "row_key", [["id"], ["profile"]]).select("row_key", "group_id").collect())
    assert got["r1"] == got["r2"] == got["r3"] and len({got["r1"], got["r4"], got["r5"]}) == 3
    chain = spark.createDataFrame([(f"n{i:03d}", f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(60)], "row_key string, a string, b string")
    assert connected_groups(chain, "row_key", [["a"], ["b"]]).select("group_id").distinct().count() == 1


def test_truncated_skill_lists(spark):
    assert one(spark, tx.skill_list(F.col("v")), "welding | Lathe; milling, grin...") == ["lathe", "milling", "welding"]
    assert one(spark, tx.skill_list(F.col("v"), False), "welding | Lathe; milling, grin...") == ["grin", "lathe", "milling", "welding"]


def test_calibration_boundary(spark):
    small = spark.createDataFrame([(0, 1)] * 5, "band int, prediction int")
    assert ordinal.calibration_radius(small).first()["radius"] == 5
    enough = spark.createDataFrame([(0, 0)] * 8 + [(0, 2)], "band int, prediction int")
    assert ordinal.calibration_radius(enough).first()["radius"] == 2


def _expected_tags(words, entries):
    """Every dictionary match of at most six words, earliest and then longest first, each taken if its words are still free."""
    spans = [(i, i + n) for i in range(len(words)) for n in range(1, 7) if i + n <= len(words)]
    named = {s: " ".join(words[slice(*s)]).lower() for s in spans}
    usable = [s for s in spans if named[s] in entries and (len(named[s]) > 2 or named[s] in {"c", "r"})]
    taken, out = set(), []
    for s in sorted(usable, key=lambda s: (s[0], -s[1])):
        if taken.isdisjoint(range(*s)):
            taken.update(range(*s))
            out.append((s[0], s[1] - s[0], entries[named[s]]))
    return out


def test_dictionary_tagging_against_scan(spark):
    rng = random.Random(2)
    words = ["Data", "science", "c", "go", "sql", "Machine", "learning", "big", "r"]
    entries = {"data": "d", "data science": "ds", "machine learning": "ml", "big data science c": "x", "c": "c", "go": "go", "sql": "sql", "learning big": "lb"}
    texts = {i: " ".join(rng.choice(words) for _ in range(40)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    dictionary = spark.createDataFrame(list(entries.items()), "key string, uri string")
    got = {}
    for r in extraction.tag_documents(docs, dictionary).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["n"], r["uri"]))
    for i, text in texts.items():
        assert sorted(got.get(i, [])) == _expected_tags(text.split(), entries)


def test_loanwords_and_extraction(spark):
    phrases = spark.createDataFrame([("p", "मेरे को टैली आता है")], "phrase_id string, phrase string")
    lexicon = spark.createDataFrame([("टैली", "tally")], "term string, english string")
    hits, rest = extraction.split_loanwords(phrases, lexicon)
    assert [tuple(r) for r in hits.select("span", "english").collect()] == [("टैली", "tally")] and rest.first()["residual"] == ""
    docs = spark.createDataFrame([(1, "Cobol, then Ada; spot welding jobs"), (2, "मेरे को टैली आता है और मेरे काम")], "doc_id long, text string")
    labels = linking.concept_labels(spark.createDataFrame(
        [("u1", "cobol", []), ("u2", "tally", []), ("u3", "spot welding job", [])], "uri string, preferred string, alternates array<string>"))
    dictionary = spark.createDataFrame([("cobol", "u1"), ("tally", "u2")], "key string, uri string")
    skills, _ = extraction.extract_skills(docs, dictionary, labels, lexicon, 0.7)
    got = {(r["doc_id"], r["uri"]): r["method"] for r in skills.collect()}
    assert got == {(1, "u1"): "exact", (1, "u3"): "embedding", (2, "u2"): "transliteration"}


def test_ranking_metrics(spark):
    from math import log2

    from talentgrid.operators.evaluation import ranking_metrics

    ranked = spark.createDataFrame([("q", i, r) for r, i in enumerate([5, 3, 9, 1], 1)], "query_id string, item_id long, rank int")
    relevant = spark.createDataFrame([("q", 3, 1), ("q", 1, 1)], "query_id string, item_id long, grade int")
    assert ranking_metrics(ranked, relevant, k=2).first()["recall"] == 0.5
    row = ranking_metrics(ranked, relevant, k=10).first()
    assert row["mrr"] == 0.5 and row["ndcg"] == pytest.approx((1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3)))


def test_budget_of_scores(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "job_id long, skill_id string")
    queries = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, skill_id string")
    stats = recommend.skill_statistics(edges)
    scores = {r["job_id"]: r["score"] for r in recommend.tfidf_cosine(queries, edges, stats).collect()}
    assert scores[1] == pytest.approx(1.0) and 0 < scores[2] < 1 and 3 not in scores


def test_sources(spark, tmp_path):
    path = tmp_path / "ref.csv"
    path.write_text('# note\n# more\nterm,english\nc#,"a, b"\n#hash,x\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_reference_csv(spark, str(path), ["term", "english"]).collect()]
    assert rows == [("c#", "a, b"), ("#hash", "x")]
    cat = tmp_path / "cat.csv"
    cat.write_text('﻿code;label;note\n0110;"two\nlines";\n', encoding="utf-8")
    df = readers.read_catalog_csv(spark, str(cat))
    assert df.columns == ["code", "label", "note"] and tuple(df.first()) == ("0110", "two\nlines", "")
    places = tmp_path / "places.txt"
    places.write_text("\t".join(["1", "Pune", "Pune", 'a"b', "1.5", "2.5", "P", "PPL", "IN", "", "16", "", "", "", "3000000", "", "", "", ""]) + "\n", encoding="utf-8")
    states = spark.createDataFrame([("16", "Maharashtra")], "code string, state string")
    assert readers.read_places(spark, str(places), states).first()["population"] == 3_000_000
    sample = spark.createDataFrame([("k1", "done")], "key string, reviewed string")
    merged = sinks.merge_review_sample(sample, spark.createDataFrame([("k1", ""), ("k2", "")], "key string, reviewed string"), "key")
    assert dict(merged.collect()) == {"k1": "done", "k2": ""}


def test_place_keys_fold_all_letters(spark):
    cases = {"Paṭna": "patna", "Thāṇe": "thane", "Ｐｕｎｅ": "pune", "Ôﬃce Ĳ-1": "office ij-1", "Straße": "strae", "दिल्ली": "", None: None}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert dict(df.select("v", tx.place_norm(F.col("v"))).collect()) == cases


def test_tier_rows_of_one_city_do_not_multiply(spark):
    cities = spark.createDataFrame([(1, "Pune", "Maharashtra"), (2, "Pune", "Goa"), (3, "Agra", None)], "job_id long, city string, state string")
    tiers = spark.createDataFrame([("Pune", 2, "Goa"), ("Pune", 1, "Maharashtra")], "city string, tier int, tier_state string")
    assert sorted((r["job_id"], r["tier"]) for r in geography.with_tier(cities, tiers).collect()) == [(1, 1), (2, 3), (3, 3)]


def test_nearest_field_walks_deep_chains_and_cycles(spark):
    from talentgrid.operators import taxonomy

    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "x")]
    skills = spark.createDataFrame([("n00",), ("x",)], "uri string")
    fields = spark.createDataFrame([("n30", "deep")], "uri string, field string")
    assert [tuple(r) for r in taxonomy.nearest_field(skills, spark.createDataFrame(chain, "src string, dst string"), fields).collect()] == [("n00", "deep")]


def test_close_values_and_common_prefixes_spread_over_ranges(spark, request):
    from talentgrid.functions import distributed as ds

    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # these rows are few enough to be put together again
    spark.conf.set(setting, "false")
    request.addfinalizer(lambda: spark.conf.unset(setting))
    rows = spark.range(60_000).select((F.col("id") / 6e6).alias("v"), F.concat(F.lit("http://example.org/skill/"), F.col("id")).alias("t"))
    for column in ("v", "t"):
        sizes = [r["count"] for r in ds._collapse(rows, [], column, None).groupBy("_range").count().collect()]
        assert len(sizes) >= 2 and max(sizes) < 3 * 60_000 / len(sizes)
        last = ds.cumulative(rows, [], column).orderBy(F.desc(column)).first()
        assert (last["before"], last["total"]) == (59_999, 60_000)
    numbers = sorted(r["k"] for r in ds.dense_numbers(rows, "t", "k").collect())
    assert numbers == list(range(60_000))
    with pytest.raises(ValueError):
        ds.dense_numbers(rows, "t", "k", 59_999)


def test_pairs_of_a_long_set_are_shared(spark):
    sets = spark.createDataFrame([(1, list(range(700)))], "owner int, items array<int>")
    pairs = item_pairs(sets, ["owner"])
    assert pairs.filter("a < b").distinct().count() == pairs.count() == 700 * 699 // 2


def test_first_and_last_listed_rows(spark, tmp_path):
    from talentgrid.functions.distributed import listed_once

    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", None)], "k string, v int").coalesce(1)
    assert sorted(map(tuple, listed_once(df, ["k"]).collect())) == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in listed_once(df, ["k"], last=True).collect()} == {("a", None), ("b", 3)}
    assert listed_once(df.select("k"), ["k"]).count() == 2
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2)], "src string, dst string, weight int").coalesce(1)
    sinks.write_graph({"N": df.withColumnRenamed("k", "uri")}, {"E": edges}, str(tmp_path), {})
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/edges_E").collect()] == [("a", "b", 2)]
