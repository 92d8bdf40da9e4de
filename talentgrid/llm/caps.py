"""Near-duplicate vectors by spherical-cap filters from random product codes.

Filter directions are all concatenations of one codeword per block, so a few hundred codewords stand for millions of
directions. Each vector, turned by random signs and Hadamard steps, is list-decoded exactly: the sums of its products
with pairs of codewords of the first half are met with those of the second half, and every direction whose product
exceeds the bound is listed. Vectors that share a label and a direction are candidates; cosines confirm them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.links import components
from talentgrid.session import cut

BLOCKS, CODEWORDS = 4, 64  # 64 ** 4 directions
LISTED = 100  # directions of a typical vector; the bound follows from it
LEAST = 50  # a vector that exceeds the bound in fewer lowers its own
SEED = 20240229


@cache
def _code(dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Signs of the two turns, codewords (block, word, dimension) and the bound on products, for vectors of `dims` dimensions."""
    width = max(16, 1 << (dims - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64(SEED + dims))
    signs = rng.choice([-1.0, 1.0], (2, width))
    words = rng.standard_normal((BLOCKS, CODEWORDS, width // BLOCKS))
    words /= np.linalg.norm(words, axis=2, keepdims=True) * BLOCKS**0.5
    sample = rng.standard_normal((64, width))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    bounds = []
    for first, second in zip(*_halves(sample, words), strict=True):
        best = np.sort(first)[-LISTED:, None] + np.sort(second)[-LISTED:]
        bounds.append(np.sort(best.ravel())[-LISTED])
    return signs, words, float(np.median(bounds))


def _turned(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vectors), signs.shape[1]))
    out[:, : vectors.shape[1]] = vectors
    for sign in signs:
        out *= sign
        step = 1
        while step < out.shape[1]:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), -1)
            step *= 2
        out /= out.shape[1] ** 0.5
    return out


def _halves(vectors: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of each vector with all codeword pairs of the first and of the second half of the blocks."""
    parts = np.einsum("nbd,bwd->nbw", vectors.reshape(len(vectors), BLOCKS, -1), words)
    return tuple((parts[:, b, :, None] + parts[:, b + 1, None, :]).reshape(len(vectors), -1) for b in (0, 2))


def directions(vectors: np.ndarray) -> list[np.ndarray]:
    """Numbers of all directions that exceed the bound, of each row of `vectors` (finite, not zero)."""
    signs, words, bound = _code(vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = []
    for first, second in zip(*_halves(_turned(unit, signs), words), strict=True):
        order = np.argsort(-second)
        rising, limit = second[order], bound
        while True:
            near = np.flatnonzero(first + rising[0] >= limit)
            counts = np.searchsorted(-rising, first[near] - limit, side="right")
            if counts.sum() >= LEAST:
                break
            limit -= 0.02
        at = np.repeat(near, counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out.append(at.astype(np.int64) * len(second) + order[place])
    return out


def _listed(classes: DataFrame) -> DataFrame:
    """(label, dims, direction, node) of every class (node, label, embedding)."""
    kinds = dict(classes.dtypes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vectors = batch.columns
            sizes = np.array([len(v) for v in vectors], np.int64)
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                for at in range(0, len(own), 64):
                    rows = pa.array(own[at : at + 64])
                    found = directions(np.array(vectors.take(rows).to_pylist(), float))
                    many = pa.array(np.repeat(np.asarray(rows), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays(
                        [node.take(many), label.take(many), pa.array(np.full(len(many), dims)), pa.array(np.concatenate(found))],
                        ["node", "label", "dims", "direction"])

    return classes.select("node", "label", "embedding").mapInArrow(
        decode, f"node {kinds['node']}, label {kinds['label']}, dims long, direction long")


def _confirmed(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    kind = dict(classes.dtypes)["node"]
    side = lambda c: classes.select(F.col("node").alias(c), F.col("embedding").alias(f"vector_{c}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            sizes = batch.column("vector_a").value_lengths().to_numpy()
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                a, b = (batch.column(c).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                        for c in ("vector_a", "vector_b"))
                dot = lambda x, y: (x * y).sum(axis=1)
                good[own] = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(confirm, f"a {kind}, b {kind}")


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `rows`: vec_id, n_links, component_id (smallest id reachable over links), kept.

    Vectors of one label and length are linked when their cosine in double precision is at least `cosine`. Equal vectors
    collapse before candidates are sought, and count as linked with each other. Rows that repeat an id are vectors of their
    own: each has its links, and a component goes by the smallest id in it. A null label or id, and a vector that is
    null, empty, zero or holds a null or non-finite number, has no links and is its own component. An empty table gives
    an empty result; other columns are not read.
    """
    values = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(values, lambda x: x != 0), F.lit(False))
    all_ = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    # Classes of equal vectors under one label go by a number, since an id may be repeated.
    classes = cut(
        all_.filter(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "n", "least", "label", "embedding"))
    listed = _listed(classes)
    left, right = (listed.select("label", "dims", "direction", F.col("node").alias(c)) for c in ("a", "b"))
    pairs = left.join(right, ["label", "dims", "direction"]).filter("a > b").select("a", "b").distinct()
    links = cut(_confirmed(pairs, classes, cosine))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(classes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    rooted = classes.join(others, "node", "left").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(rooted.select("label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "root", "least"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    known = cut(named.drop("least").join(firsts, "root").drop("root"))
    held = all_.withColumn("sound", sound)
    match = held["sound"] & (held["label"] == known["label"]) & (held["embedding"] == known["embedding"])
    component = F.coalesce("first", "vec_id")
    return held.join(known, match, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
