"""Nearest neighbours from balanced posting lists, selected by a graph over their centroids.

A bounded sample is halved again and again across its longest spread into parts of equal size, whose means are the lists'
centroids; so dense regions get many lists. Every vector goes to the list of its nearest centroid, and one near a
boundary to further ones as well, unless a list it already has stands between. Centroids are found by walking a graph of
neighbours held by every task. A query reads the lists whose centroids are within a ratio of its nearest one's distance,
and more until they hold enough vectors. Lists and their queries are cut into parts that meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import cut

SAMPLE_ROWS = 16_384  # rows at most that centroids are learnt from
MOST_LISTS = 2048  # of one vector length; lists grow with the root of the rows up to it, and in size beyond
REPLICAS, BOUNDARY = 4, 1.03  # a vector's lists at most, and how much further than the nearest centroid theirs may be
RATIO = 1.15  # how much further than the nearest one the centroids of a query's lists may be
DEGREE, BEAM = 16, 8  # spread links of a centroid; nodes a walk expands at least
PART_NUMBERS = 1 << 18  # vector components in a part of a list
QUERY_NUMBERS = 1 << 16  # and in a part of its queries


def balanced_centroids(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of `lists` parts of the sample, all of about equal size; neighbours in the result are close."""
    if lists <= 1 or len(sample) < 2 * lists:
        return sample.mean(0, keepdims=True)
    centre = sample.mean(0)
    axis = sample[rng.integers(len(sample))] - centre
    left = lists // 2
    at = len(sample) * left // lists
    for _ in range(4):
        order = np.argsort(sample @ axis, kind="stable")
        low, high = sample[order[:at]], sample[order[at:]]
        axis = high.mean(0) - low.mean(0)
    return np.concatenate([balanced_centroids(low, left, rng), balanced_centroids(high, lists - left, rng)])


def _links(apart: np.ndarray) -> np.ndarray:
    """Links of each centroid (padded with its own number): nearest ones, spread ones, links turned round, and neighbours in order.

    A spread link leads to a centroid to which none of the spread links before it is closer. Turned links lead out of
    centroids that are near to many others.
    """
    k = len(apart)
    own = np.arange(k)
    ranked = np.argsort(apart + np.diag(np.full(k, -1.0)), 1, kind="stable")[:, 1 : 8 * DEGREE + 1]
    spread, filled = np.tile(own[:, None], (1, DEGREE)), np.zeros(k, int)
    for near in ranked.T:
        used = np.arange(DEGREE) < filled[:, None]
        ok = (filled < DEGREE) & ~(used & (apart[spread, near[:, None]] < apart[own, near][:, None])).any(1)
        spread[ok, filled[ok]] = near[ok]
        filled += ok
    out = np.concatenate([ranked[:, : DEGREE // 2], spread], 1)
    back: list[list[int]] = [[] for _ in own]
    for a, b in zip(np.repeat(own, out.shape[1]), out.ravel(), strict=True):
        back[b].append(a)
    all_ = [sorted(set(o) | set(sorted(r, key=lambda a: apart[a, i])[: 4 * DEGREE]) | {(i + 1) % k, (i - 1) % k}) for i, (o, r) in enumerate(zip(out.tolist(), back, strict=True))]
    links = np.tile(own[:, None], (1, max(map(len, all_))))
    for i, to in enumerate(all_):
        links[i, : len(to)] = to
    return links


class Graph:
    """Centroids with links among them, for walks."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.centroids = centroids
        self.apart = np.sqrt(np.maximum(_squares(centroids, centroids), 0))
        self.links = _links(self.apart)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 1 + int(k**0.5))).astype(int))

    def __reduce__(self):  # tasks are sent the centroids alone
        return Graph, (self.centroids,)

    def search(self, vectors: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of up to `width` centroids found (-1: none) and their distances, nearest first, by a walk from the entries.

        A walk expands its nearest `BEAM` nodes and all within `ratio` of its nearest.
        """
        n, k = len(vectors), len(self.centroids)
        width = min(width, k)
        entries = np.sqrt(np.maximum(_squares(vectors, self.centroids[self.entries]), 0))
        ids, far = np.full((n, width), -1), np.full((n, width), np.inf)
        order = np.argsort(entries, 1, kind="stable")[:, :width]
        ids[:, : order.shape[1]], far[:, : order.shape[1]] = self.entries[order], np.take_along_axis(entries, order, 1)
        seen, done = np.zeros((n, k), bool), ids < 0
        seen[:, self.entries] = True
        while True:
            open_ = ~done & ((np.arange(width) < BEAM) | (far <= ratio * far[:, :1]))
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids, far
            pick = open_[rows].argmax(1)
            done[rows, pick] = True
            reached = self.links[ids[rows, pick]]
            fresh = ~seen[rows[:, None], reached]
            seen[rows[:, None], reached] = True
            new = np.sqrt(((vectors[rows][:, None] - self.centroids[reached]) ** 2).sum(2))
            new[~fresh] = np.inf
            all_far = np.concatenate([far[rows], new], 1)
            best = np.argsort(all_far, 1, kind="stable")[:, :width]
            far[rows] = np.take_along_axis(all_far, best, 1)
            ids[rows] = np.where(np.isinf(far[rows]), -1, np.take_along_axis(np.concatenate([ids[rows], reached], 1), best, 1))
            done[rows] = np.isinf(far[rows]) | np.take_along_axis(np.concatenate([done[rows], np.zeros_like(fresh)], 1), best, 1)

    def member_lists(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each vector (-1: none), the nearest first, and which of them are taken."""
        ids, far = self.search(vectors, 2 * BEAM, BOUNDARY)
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for i in range(1, ids.shape[1]):
            between = (taken[:, :i] & (self.apart[ids[:, :i], ids[:, i, None]] < far[:, i, None])).any(1)
            taken[:, i] = (ids[:, i] >= 0) & (far[:, i] <= BOUNDARY * far[:, 0]) & ~between & (taken.sum(1) < REPLICAS)
        return ids, taken

    def query_lists(self, vectors: np.ndarray, sizes: np.ndarray, enough: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each query, nearest first, and which of them are read: within the ratio, and until `enough` vectors are there."""
        k = len(self.centroids)
        ids, far = self.search(vectors, k, ratio)
        short = np.flatnonzero(np.where(ids >= 0, sizes[ids], 0).sum(1) < enough)
        if len(short):
            all_far = np.sqrt(np.maximum(_squares(vectors[short], self.centroids), 0))
            ids[short] = np.argsort(all_far, 1, kind="stable")
            far[short] = np.take_along_axis(all_far, ids[short], 1)
        held = np.where(ids >= 0, sizes[ids], 0)
        before = np.cumsum(held, 1) - held
        return ids, (ids >= 0) & ((far <= ratio * far[:, :1]) | (before < enough))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T


def nearest_rows(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, places of its `k` nearest vectors but its own row, and their distances; ties by id, then row.

    A product of matrices rules out most; what is within its rounding of the k-th distance is measured component by component.
    """
    squares = _squares(queries, vectors)
    room = 1e-9 * ((queries**2).sum(1)[:, None] + (vectors**2).sum(1).max(initial=0))
    last = min(k, len(vectors) - 1)  # one more than k, as the query's own row may be among them
    bound = np.partition(squares, last, 1)[:, last, None] + 2 * room
    for i, close in enumerate(~(squares > bound)):
        at = np.flatnonzero(close & (rows != own[i]))
        far = np.sqrt(((vectors[at] - queries[i]) ** 2).sum(1))
        best = np.lexsort((rows[at], ids[at], far))[:k]
        yield at[best], far[best]


def sound_vector(vector: Column) -> Column:
    """Whether a vector is there, not all zero, and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _by_length(batch: pa.RecordBatch, step: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = batch.column("dims").to_numpy()
    for dims in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dims)
        for at in range(0, len(own), step):
            part = batch.take(pa.array(own[at : at + step]))
            yield dims, part, _matrix(part.column("vector"), dims)


def _dealt(rows: DataFrame, choose) -> DataFrame:
    """(row, id, dims, vector, list, first) of every list that `choose(dims, vectors)` takes for a row."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", list int, first boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part, vectors in _by_length(batch, 512):
                ids, taken = choose(dims, vectors)
                row, place = np.nonzero(taken)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(ids[row, place], pa.int32()), pa.array(place == 0)], [*out.schema.names, "list", "first"])

    return rows.mapInArrow(deal, schema)


def nearest_neighbours(
    rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest rows found of every row that `is_query` holds for, by Euclidean distance.

    Candidates are all rows but the query's own; distances are taken in double precision on the vectors as they are, ties
    go to the smaller id, rows without id last. Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, and vectors of different lengths do not meet. Rows that repeat an id or a vector are rows of their own:
    a query then finds its copies, and a repeated query id has the ranks of each of its rows. With fewer than `k`
    candidates a query finds all. An empty table gives an empty result; columns but the id, the vector and those of
    `is_query` are not read. The centroids, and one row per vector length, are all that reaches the driver.
    """
    kind = dict(rows.dtypes)[id_col]
    all_ = cut(
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(sound_vector(F.col("vector"))).select(
            F.monotonically_increasing_id().alias("row"), "id", F.size("vector").alias("dims"), "vector", "asks"))
    counts = {r.dims: r.n for r in all_.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    spread = F.xxhash64("row", F.lit(12))
    sample = all_.filter(F.pmod(spread, F.lit(max(1, total // (2 * SAMPLE_ROWS)))) == 0).orderBy(spread).limit(SAMPLE_ROWS).select("dims", "vector").collect()
    graphs = {}
    for dims, n in sorted(counts.items()):
        seen = np.array([r.vector for r in sample if r.dims == dims], float).reshape(-1, dims)
        lists = min(MOST_LISTS, 1 + int(n**0.5 / 2))
        graphs[dims] = Graph(balanced_centroids(seen, lists, np.random.default_rng(12)) if len(seen) else np.zeros((1, dims)))
    members = cut(_dealt(all_.drop("asks"), lambda dims, vectors: graphs[dims].member_lists(vectors)))
    held = members.groupBy("dims", "list").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("n_first"))
    sizes = {d: np.zeros(len(g.centroids), np.int64) for d, g in graphs.items()}
    for r in held.collect():  # a row per list
        sizes[r.dims][r.list] = r.n_first
    asked = cut(_dealt(all_.filter("asks").drop("asks"), lambda dims, vectors: graphs[dims].query_lists(vectors, sizes[dims], k + 1, ratio)))
    asks = asked.groupBy("dims", "list").agg(F.count(F.lit(1)).alias("n_asked"))
    parts_of = lambda n, numbers: F.ceil(F.col(n) * F.col("dims") / numbers).cast("int")
    cuts = held.join(asks, ["dims", "list"]).select(
        "dims", "list", parts_of("n", PART_NUMBERS).alias("parts"), parts_of("n_asked", QUERY_NUMBERS).alias("blocks"))
    cuts = F.broadcast(cut(cuts))  # a row per list
    some = lambda of: F.pmod(F.xxhash64("row"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    key = ["dims", "list", "part", "block"]
    left = asked.join(cuts, ["dims", "list"]).select("row", "id", "vector", "dims", "list", some("blocks").alias("block"), each("parts").alias("part"))
    right = members.join(cuts, ["dims", "list"]).select("row", "id", "vector", "dims", "list", some("parts").alias("part"), each("blocks").alias("block"))

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        queries, found = queries.combine_chunks(), found.combine_chunks()
        if not queries.num_rows or not found.num_rows:
            return pa.table({"query": queries["row"][:0], "query_id": queries["id"][:0], "row": queries["row"][:0], "vec_id": queries["id"][:0],
                             "score": pa.array([], pa.float64())})
        dims = queries["dims"][0].as_py()
        matrix = lambda t: _matrix(pa.concat_arrays(t["vector"].chunks), dims)
        rows_, ids = found["row"].to_numpy(), found["id"].fill_null(np.iinfo(np.int64).max).to_numpy() if found["id"].null_count else found["id"].to_numpy()
        best = list(nearest_rows(matrix(queries), queries["row"].to_numpy(), matrix(found), rows_, ids, k))
        asking, at = pa.array(np.repeat(np.arange(len(best)), [len(p) for p, _ in best])), pa.array(np.concatenate([p for p, _ in best]))
        return pa.table({"query": queries["row"].take(asking), "query_id": queries["id"].take(asking), "row": found["row"].take(at),
                         "vec_id": found["id"].take(at), "score": pa.array(np.concatenate([f for _, f in best]))})

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        meet, f"query long, query_id {kind}, row long, vec_id {kind}, score double")
    # A row found in several lists has one rank.
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = near.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).dropDuplicates(["query", "rank"])
    return ranked.select("query_id", "rank", "vec_id", "score")
