"""Page text, quality scores, near vectors, mixtures and the pipeline."""

from collections import Counter, defaultdict
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentgrid.llm import caps, mixing, pages, quality
from talentgrid.llm.queries import QUERIES, held_out

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class=site-header><h1>Site</h1>
<ul><li><a href=/>Home</a><li><a href=/x>Two words</a></ul></header><div class="cookie-notice">We use cookies. Please accept them.</div>
<div id=wrap><div class="article-header"><h1>The title</h1></div><p>Short one.<p>A long paragraph &amp; text with <a href=q>a link</a>, and
more&nbsp;words &#8212; fine.<div class=ad-box>Buy now! Cheap shoes for everyone.</div><p>Second long paragraph which has a number of words.
<ul><li>Item one of the list</li><li>Item two of the list</ul><blockquote>Quote me.</blockquote><form><label>Email</label><button>Send</button></form>
<section class="comments"><h3>Comments</h3><p>I really like this article, thank you very much.</p></section></div>
<aside><p>Some text in a sidebar that is quite long and has sentences.</p></aside><script>if(a<b)"</p>"</script><footer><p>(c) Corp.</p></footer>"""


def test_main_text(spark):
    rows = [(1, PAGE, "a"), (2, None, "b"), (3, "", "c"), (4, "plain text only, no markup at all here.", "d"), (5, "<p>a<b", "e"), (6, PAGE, "a"),
            (7, "<article>" + "<p>Some words in a row, again.</p>" * 3000 + "</article>", "f"), (8, "<nav><a href=x>Menu entry</a></nav><!-- <p>no</p>", "g")]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame([(i, h, u, 9) for i, h, u in rows], "page_id long, html string, url string, text int")).collect()}
    want = ("The title\nShort one.\nA long paragraph & text with a link, and more words — fine.\nSecond long paragraph which has a number of words.\n"
            "Item one of the list\nItem two of the list\nQuote me.")
    assert got[1].text == got[6].text == want
    assert [got[i].text for i in (2, 3, 5, 8)] == ["", "", "a", ""] and got[4].text == rows[3][1]
    assert got[7].text == "\n".join(["Some words in a row, again."] * 3000)
    empty = spark.createDataFrame([], "page_id long, html string, url string")
    assert pages.main_text(empty).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            own = sum(math.log1p(math.exp(-z)) if c else math.log1p(math.exp(z)) for z, c in zip(odds, labels))
            return own + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(pages.minimum_cut(odds, edges)) == pytest.approx(best)


def test_every_page_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op1_main_text"](spark, folder).collect():
        body = html[r.page_id].partition("<article>")[2].partition("</article>")[0]
        body = body.replace("</p>", "\n").replace("<p>", "\n").replace("<h1>", "\n").replace("</h1>", "\n").replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        import html as entities

        assert r.text.split("\n") == [x for x in (" ".join(entities.unescape(x).split()) for x in body.split("\n")) if x] and r.n_chars == len(r.text)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [r.predicted for r, q in labels if q == 1], [r.predicted for r, q in labels if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.04


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in [(1, None), (2, ""), (3, "x " * 100_000), (4, "a b"), (4, "a b"), (None, "c")]], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()] == [0.5] * 6
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (77, 0)], "doc_id long, quality int")
    assert quality.scored(docs, quality.fit(docs, one)).first().score == 0.75
    few = spark.createDataFrame([(i, f"word{i} and words of {i}" if i % 2 else f"{i}%%% ###{i} $$$") for i in range(40)], "doc_id long, text string")
    labels = few.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(few, labels, ~held_out("doc_id"))
    scores = {r.doc_id: r.score for r in quality.scored(few, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    assert {r.doc_id: r._s for r in quality.with_scores(few, model, "_s").collect()} == scores
    assert quality.scored(docs.filter("false"), model).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(24)
            rows += [(label, (base + rng.standard_normal(24) * s).tolist()) for s in (0, 0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)]
    rows += [(0, None), (0, [0.0] * 24), (0, [float("nan")] * 24), (0, [None] * 24), (0, [float("inf")] + [1.0] * 23), (0, []), (1, [1.0] * 7), (1, [2.0] * 7), (1, [1.0] + [0.0] * 23)]
    df = spark.createDataFrame([(i, v, label, 5) for i, (label, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n_links int")
    got = caps.near_vectors(df).collect()

    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v, np.float32).astype(float) for i, (label, v) in enumerate(rows) if label is not None and sound(v)}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if rows[a][0] == rows[b][0] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] / (np.sqrt(unit[a] @ unit[a]) * np.sqrt(unit[b] @ unit[b])) >= 0.98]
    root, degree = {i: i for i in range(len(rows))}, Counter(itertools.chain(*links))
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, degree[i], root[i], root[i] == i) for i in root} and len(links) > 100
    assert caps.near_vectors(df.filter("false")).count() == 0


def test_listed_directions_are_all_that_exceed():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3, 16))
    signs, words, bound = caps._code(16)
    turned = caps._turned(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), signs)
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    for row, listed in zip(turned, caps.directions(vectors)):
        first = [words[0] @ row[:4], words[1] @ row[4:8], words[2] @ row[8:12], words[3] @ row[12:]]
        every = (first[0][:, None, None, None] + first[1][:, None, None] + first[2][:, None] + first[3]).ravel()
        limit = bound
        while (every >= limit).sum() < caps.LEAST:
            limit -= 0.02
        assert set(listed) == set(np.flatnonzero(every >= limit))


def levels():
    return {"domain": F.col("domain"), "lang": F.col("lang")}


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", "y"]), " ".join(["w"] * rng.randint(0, 40))) for i in range(400)] + [
        (500, "a", "x", None), (501, "d", "z", "one two"), (501, "d", "z", "one two"), (502, "d", "z", "w " * 300)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, domain string, lang string, text string, copies int")
    weights = {("a",): 5.0, ("b",): 1.0, ("d",): 0.01, ("a", "x"): 3.0, ("a", "y"): 1.0}
    got = mixing.mixture(docs, levels(), weights, share=0.8, max_epochs=2, seed=3).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, d, lang, t in rows:
        size[(d or "(none)", lang)] += len((t or "").split())

    def filled(budget, rooms, weight):
        share, open_ = {}, dict(rooms)
        while open_:
            level = (budget - sum(share.values())) / sum(weight(k) for k in open_)
            full = {k: r for k, r in open_.items() if r <= level * weight(k) * (1 + 1e-12)}
            if not full:
                return share | {k: level * weight(k) for k in open_}
            share |= full
            open_ = {k: r for k, r in open_.items() if k not in full}
        return share

    total = sum(size.values())
    top = filled(0.8 * total, {d: 2 * sum(v for k, v in size.items() if k[0] == d) for d in {k[0] for k in size}}, lambda d: weights.get((d,), 1.0))
    target = {}
    for d, budget in top.items():
        own = filled(budget, {k: 2 * v for k, v in size.items() if k[0] == d}, lambda k: weights.get(k, 1.0))
        target |= own
    used, biggest = defaultdict(int), defaultdict(int)
    for r in got:
        used[(r.domain, r.lang)] += r.copies * r.n_tokens
        biggest[(r.domain, r.lang)] = max(biggest[(r.domain, r.lang)], r.n_tokens)
        assert 0 <= r.copies <= 2
    for leaf, t in target.items():
        assert t - biggest[leaf] - 1 <= used[leaf] <= t + 1
    again = mixing.mixture(docs.repartition(7), levels(), weights, share=0.8, max_epochs=2, seed=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter(map(tuple, got)) != Counter(map(tuple, mixing.mixture(docs, levels(), weights, 0.8, 2, seed=4).collect()))
    assert mixing.mixture(docs.filter("false"), levels(), weights, 0.8).count() == 0


def test_pipeline_stages_take_odd_documents(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = lambda i: f"%%% {i} ### $$$ {i * 7} &&& !! ***" * 9 if i % 7 == 0 else f"This is text number {i}, which says {i * i} words of its own and ends here in peace."
    rows = [(i, text(i), "en" if i % 3 else "de", f"src{i % 5}", 9) for i in range(60)] + [
        (60, None, None, None, None), (61, "", "en", "src1", 0), (62, text(5), "en", "src1", 9), (63, text(5) + "\n\n" + text(8), "en", "x", 9),
        (64, "peace is here " * 9000, "fr", "src0", 1), (None, text(11), "en", "src2", 3), (7, text(9), "en", "src2", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        before = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, before, str(tmp_path))
            made.write.parquet(f"{tmp_path}/{docs.count()}-{k}")
            after = spark.read.parquet(f"{tmp_path}/{docs.count()}-{k}")
            if k < 4:
                assert after.columns == docs.columns and after.count() <= before.count()
            before = after
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/{len(rows)}-4").collect()}
    assert all(r.ids_sha256 and r.n_tokens == len(r.ids) for r in kept.values())
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{len(rows)}-1").collect()}.isdisjoint({62})  # nothing is left of a copy
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    rng = random.Random(8)
    v, w = ([rng.gauss(0, 1) for _ in range(16)] for _ in range(2))
    near = [x + 0.01 * rng.gauss(0, 1) for x in v]
    rows = [(1, v, 0), (1, w, 1), (2, near, 0), (3, w, 1), (1, w, 1), (4, near, 1), (0, v, 0), (7, None, 0), (None, v, 0)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()

    def linked(a, b):
        (i, x, m), (j, y, n) = rows[a], rows[b]
        if a == b or None in (i, j, x, y) or m != n:
            return False
        return np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.98

    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[a]] + [root[b] for b in range(len(rows)) if linked(a, b)], key=lambda r: (rows[r][0] is None, rows[r][0])) for a in range(len(rows))]
    want = Counter((rows[a][0], sum(linked(a, b) for b in range(len(rows))), rows[root[a]][0]) for a in range(len(rows)))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("dims", [16, 64, 256])
def test_pairs_at_the_cosine_are_found(spark, dims):
    rng, rows = np.random.default_rng(dims), []
    for i in range(150):
        a, b = rng.standard_normal((2, dims))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (0.9801 * a + math.sqrt(1 - 0.9801**2) * b).tolist(), i % 3)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.component_id == r.vec_id - 1 for r in got if r.vec_id % 2) >= 0.97 * 150


def test_pipeline_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "src1", 13, 0.1, True, "x")], "doc_id long, text string, lang string, source string, n_chars long, score double, had boolean, line_owner_0 string")
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.collect()]
    assert corpus_pipeline.fresh(docs, "score") == "_score" and corpus_pipeline.fresh(docs, "other") == "other"
