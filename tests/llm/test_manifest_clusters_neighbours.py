"""Manifests, integer clusters and nearest neighbours against brute force."""

from collections import defaultdict
from hashlib import sha256
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid.llm import centroids, manifest, posting_lists
from talentgrid.llm.queries import FIELDS, QUERIES

NAN, INF = float("nan"), float("inf")


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes):
    """Root of the nodes and each one's (before, after) siblings up to it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, at):
            run = nodes[place - place % 16 : place - place % 16 + 16]
            path.append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        nodes, at = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_that_of_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = []
    for source, n in (("a", 300), ("b", 1), (None, 17), ("", 16), ("Z", 2), ("é", 33)):
        for _ in range(n):
            rows.append((rng.randrange(10_000), rng.choice(["Some TEXT", "none", "", None, "ÄÖ x"]), rng.choice(["en", None]), source, rng.choice([3, None])))
    rows += [rows[0], rows[0], (None, "No Id", "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int")
    got = manifest.manifest(
        docs, FIELDS, {"text": manifest.folded_case(F.col("text"))}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and dict(got.dtypes)["doc_id"] == "bigint"
    trees = defaultdict(list)
    for i, t, la, s, n in rows:
        low = t if t is None else "".join(c.lower() if c.isascii() else c for c in t)
        changed = leaf((i, s, la, n, low)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        trees[s].append((i is not None, i or 0, leaf((i, s, la, n, t)), i, changed))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: grown([r[2] for r in sorted(trees[s], key=lambda r: r[:3])]) for s in order}
    root, above = grown([tops[s][0] for s in order])
    want = []
    for s, up in zip(order, above):
        for (_, _, node, i, changed), path in zip(sorted(trees[s], key=lambda r: r[:3]), tops[s][1]):
            now = changed or node
            for before, after in path + up:
                now = digest(before + now + after)
            want.append((i, node, tops[s][0], root, digest("".join(b + a for b, a in path + up)), now, now == root))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(7, "s", "t")], "doc_id long, source string, text string")
    row = manifest.manifest(one, ("doc_id", "source", "text")).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf((7, "s", "t")) and row.proof_sha256 == digest("") and row.verified
    assert manifest.manifest(one.limit(0), ("doc_id", "source", "text")).collect() == []


def clustered(vectors, k, rounds, seed):
    """vec_id, cluster, distance by the plain rounds, and the final centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, digest(f"{seed}:{r[0]}"), r[1]))[:k]
    middle = [list(v) for _, v in start]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, n) in zip(kept, near()):
            own[n].append(v)
        for n, members in own.items():
            middle[n] = [sum(c) // len(members) for c in zip(*members)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, near())], middle


def test_clusters_are_those_of_plain_rounds(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 2)]) for _ in range(3)]) for i in range(400)]
    vectors += [(400, None), (401, []), (402, [1.0, None, 2.0]), (403, [NAN, 0.0, 0.0]), (404, [INF, 0.0, 0.0]), (405, [1.0] * 4), (406, [0.0] * 3)]
    vectors += [(None, [0.25, 0.25, 0.25]), (7, [0.5, 0.5, 0.5]), vectors[9], vectors[9], (500, [3e4, -3e4, 2.5])]
    rows = spark.createDataFrame([(i, v, "c") for i, v in vectors], "vec_id long, embedding array<double>, cluster string")
    for k in (1, 13, 1000):
        got, middle = centroids.clusters(rows, k=k, rounds=4, seed=2, dims=3)
        want, plain = clustered(vectors, k, 4, 2)
        assert middle == plain
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    report = centroids.cluster_report(got, middle).collect()
    assert {r.inertia for r in report} == {sum(w[2] for w in want)}
    assert all(r.centroid_sha256 == digest(",".join(map(str, middle[r.cluster]))) for r in report)
    none = rows.filter("vec_id in (400, 403)")
    assert centroids.cluster_report(*centroids.clusters(none, dims=3)).collect() == []


def test_scans_find_what_all_comparisons_find():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 64):
        values = rng.integers(-300, 300, (50, dims))
        values[7] = values[3]
        vectors = np.concatenate([rng.integers(-300, 300, (500, dims)), values, np.full((1, dims), 1 << 26)])
        which, far = centroids.Centroids(values).nearest(vectors)
        all_far = ((vectors[:, None] - values) ** 2).sum(2)
        assert (far == all_far.min(1)).all() and (which == all_far.argmin(1)).all()


def neighbours(rows, k):
    """Rows of (row, query id, [(distance, id), ...]) by comparing all."""
    kept = [(n, i, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for n, i, v in kept:
        if i is not None and i % 100 == 0:
            far = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j is None, j or 0, m) for m, j, w in kept if m != n and len(w) == len(v)]
            yield i, [(None if null else j, d) for d, null, j, _ in sorted(far)[:k]]


def test_neighbours_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, 4000, 50)]
    rows += [(1, [1.0, 0.0]), (100_000, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.5, 0.5]), (None, [2.0, 2.0])]
    rows += [(100_100, None), (100_200, []), (100_300, [0.0] * 4), (100_400, [NAN] * 4), (100_500, [1.0, None, 0.0, 0.0]), (100_600, [INF] * 4), (100_700, [1.0])]
    rows += [(100_800, [1.0] * 4)] * 3 + [(51, rows[0][1]), (50, rows[0][1])]
    table = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, row int")
    got = defaultdict(list)
    for r in sorted(posting_lists.nearest_neighbours(table, F.col("vec_id") % 100 == 0, ratio=INF).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    want = defaultdict(list)
    for i, found in neighbours(rows, 10):
        want[i] += found
    for i, found in want.items():
        assert sorted(got.pop(i, []), key=str) == sorted(found, key=str)
    assert not got
    assert len(want[100_000]) == 4 and want[100_700] == []
    assert posting_lists.nearest_neighbours(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_ranks_and_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in QUERIES["op12_nearest_vectors"](spark, folder).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = dict(neighbours(rows, 10))
    hits = 0
    for i, found in want.items():
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in found})
        true = dict(found)
        assert all(true.get(v, s) == pytest.approx(s, abs=1e-12) for _, v, s in mine)
    assert hits >= 0.95 * 10 * len(want)


def test_lists_are_balanced_and_replicas_are_near():
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.standard_normal((3000, 16)), np.full((1000, 16), 0.1) + 1e-4 * rng.standard_normal((1000, 16))])
    graph = posting_lists.Graph(posting_lists.balanced_centroids(vectors, 64, np.random.default_rng(1)))
    ids, taken = graph.member_lists(vectors)
    far = np.sqrt(((vectors[:, None] - graph.centroids) ** 2).sum(2))
    assert (ids[:, 0] == far.argmin(1)).mean() > 0.95
    assert np.bincount(ids[:, 0], minlength=64).max() < 400 and taken[:, 0].all() and 1 <= taken.sum(1).max() <= posting_lists.REPLICAS
    sizes = np.bincount(ids[:, 0], minlength=64)
    ids, read = graph.query_lists(vectors[:50], sizes, 100, 1.0)
    assert all(sizes[i[r]].sum() >= 100 for i, r in zip(ids, read))
    ids, read = graph.query_lists(vectors[:50], sizes, 1, INF)
    assert (np.sort(ids, 1) == np.arange(64)).all() and read.all()
