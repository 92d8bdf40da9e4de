"""Exact nearest-neighbour joins over vector columns by cells around pivots.

Items go to the cell of their nearest pivot. By the triangle inequality no item of a cell has a larger inner product with
a query than the pivot's plus the query's length times the cell's radius, and none encloses a smaller angle with it than
the pivot's less the cell's widest. A query first meets the cells that promise most, which gives it a k-th score, and then
only cells whose bound reaches that score. Queries and items of a cell are packed into bounded blocks that meet as matrix
products. Items that share an owner, as labels share a concept, are pooled inside the product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talentgrid.functions.distributed import best_per_group
from talentgrid.session import broadcast_if_small, cut

QUERY_ROWS, ITEM_ROWS = 1024, 4096
PIVOTS = 256  # cells at most; each holds at least one block of items on average
SLACK = 1e-9


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _angles(products: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = a[:, None] * b
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip(np.where(scale > 0, products / scale, 1.0), -1, 1))


class Cells:
    """Pivots with the reach of their cells: the farthest item, the widest angle to one, and the longest item."""

    def __init__(self, pivots: np.ndarray, reach: np.ndarray | None = None, widest: np.ndarray | None = None, longest: np.ndarray | None = None):
        self.pivots, self.lengths = pivots, np.linalg.norm(pivots, axis=1)
        self.reach, self.widest, self.longest = reach, widest, longest

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, its distance and angle to the pivot, and its length."""
        lengths = np.linalg.norm(vectors, axis=1)
        products = vectors @ self.pivots.T
        cell = np.argmin(self.lengths**2 - 2 * products, axis=1)
        at = np.arange(len(vectors))
        far = np.linalg.norm(vectors - self.pivots[cell], axis=1)
        return cell, far, _angles(products, lengths, self.lengths)[at, cell], lengths

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that any item of each cell can have with each query."""
        lengths = np.linalg.norm(queries, axis=1)
        products = queries @ self.pivots.T
        straight = products + lengths[:, None] * self.reach
        turned = np.cos(np.maximum(_angles(products, lengths, self.lengths) - self.widest - 1e-7, 0))
        # A negative cosine is worst for the shortest item, of which nothing is known.
        return np.minimum(straight, lengths[:, None] * self.longest * np.maximum(turned, 0)) + 1e-9 * (1 + lengths[:, None] * self.longest)


def _celled(items: DataFrame, cells: Cells) -> DataFrame:
    """Items with cell, far, angle and length; vectors without numbers fall out."""
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", cell int, far double, angle double, length double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far, angle, length = cells.nearest(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(angle), pa.array(length)],
                    [*batch.schema.names, "cell", "far", "angle", "length"])

    return items.mapInArrow(place, schema)


def _meeting_cells(queries: DataFrame, cells: Cells, sizes: np.ndarray, k: int, first: bool) -> DataFrame:
    """(query rows, cell): the cells that promise most until they hold k items, or those whose bound reaches `least`."""
    schema = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes) + ", cell int"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = np.where(sizes > 0, cells.bounds(_matrix(batch.column("vector"))), -np.inf)
            order = np.argsort(-bounds, axis=1, kind="stable")
            held = sizes[order]
            early = (np.cumsum(held, axis=1) - held < k) & (held > 0)
            if not first:
                least = batch.column("least").fill_null(-np.inf).to_numpy()
                early = ~early & (np.take_along_axis(bounds, order, 1) >= least[:, None] - SLACK) & (held > 0)
            row, place = np.nonzero(early)
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(order[row, place], pa.int32())], [*out.schema.names, "cell"])

    return queries.mapInArrow(choose, schema)


def _blocks(rows: DataFrame, ids: list[str], size: int, prefix: str) -> DataFrame:
    """Rows of a cell packed into hash blocks of about `size` vectors: id arrays and one flat number array per block."""
    counts = broadcast_if_small(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_n")))
    packed = rows.join(counts, "cell").groupBy("cell", F.pmod(F.xxhash64(ids[0]), F.col("_n")).alias(f"{prefix}_block")).agg(
        F.collect_list(F.struct(*ids, F.col("vector").cast("array<double>").alias("v"))).alias("rows"))
    return packed.select(
        "cell", f"{prefix}_block", *[F.transform("rows", partial(lambda i, r: r[i], i)).alias(f"{prefix}_{i}") for i in ids],
        F.flatten(F.transform("rows", lambda r: r["v"])).alias(f"{prefix}_values"))


class Pool:
    """Vectors with their owners, put in order of owners."""

    def __init__(self, vectors: np.ndarray, owners: list):
        names = np.asarray(owners, dtype=object)
        order = np.argsort(names, kind="stable")
        names = names[order]
        self.starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        self.vectors, self.names = vectors[order], names[self.starts]

    def best(self, asked: np.ndarray, queries: np.ndarray, k: int, exclude_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best owners of each query: query, owner and score, which is that of the owner's best vector."""
        scores = np.maximum.reduceat(queries @ self.vectors.T, self.starts, axis=1)
        keep = min(k + int(exclude_same), len(self.names))
        best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :keep]
        asked = np.repeat(asked, keep)
        found, score = self.names[best.ravel()], np.take_along_axis(scores, best, axis=1).ravel()
        if exclude_same:
            other = asked != found
            asked, found, score = asked[other], found[other], score[other]
        return asked, found, score


def _objects(ids: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), dtype=object)
    out[:] = ids.to_pylist()
    return out


def _products(pairs: DataFrame, query: str, item: str, schema: StructType, k: int, exclude_same: bool) -> DataFrame:
    """The k best owners of each query of every block pair."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_values, owners, values in zip(*(batch.column(c) for c in ("q_id", "q_values", "i_owner", "i_values")), strict=True):
                a = q_values.values.to_numpy(zero_copy_only=False).reshape(len(q_ids), -1)
                b = values.values.to_numpy(zero_copy_only=False).reshape(len(owners), -1)
                asked, found, score = Pool(b, owners.values.to_pylist()).best(_objects(q_ids.values), a, k, exclude_same)
                types = batch.schema.field("q_id").type.value_type, batch.schema.field("i_owner").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.tolist(), types[0]), pa.array(found.tolist(), types[1]), pa.array(score)], [query, item, "score"])

    return pairs.select("q_id", "q_values", "i_owner", "i_values").mapInArrow(products, schema)


def _beside_pool(queries: DataFrame, pool: Pool, owner_type: pa.DataType, query: str, item: str, schema: StructType, k: int, exclude_same: bool) -> DataFrame:
    """The k best owners of each of `queries(id, vector)` where all items are one small pool: queries are not shuffled."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(start, QUERY_ROWS)
                asked, found, score = pool.best(_objects(part.column("id")), _matrix(part.column("vector")), k, exclude_same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.tolist(), batch.schema.field("id").type), pa.array(found.tolist(), owner_type), pa.array(score)], [query, item, "score"])

    return queries.mapInArrow(products, schema)


def block_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks of `queries(id, vector, cell)` beside all blocks of `items(owner, vector, cell)` of their cell."""
    return _blocks(queries, ["id"], QUERY_ROWS, "q").join(_blocks(items, ["owner"], ITEM_ROWS, "i"), "cell")


def first_owners(items: DataFrame, k: int) -> DataFrame:
    """Of the owners of one and the same vector the k smallest, `items(owner, vector)`: no other is among the k best of a query."""
    return best_per_group(items.distinct(), ["vector"], [F.asc("owner")], k, "_place").drop("_place")


def nearest(
    queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "item_id", vector: str = "vector",
    exclude_same: bool = False, pivots: int | None = None,
) -> DataFrame:
    """The k items with the largest inner product per query, exactly, ties broken by item id: (query, item, score, rank).

    For unit vectors the score is the cosine. Rows of `items` may share an id; the id's score is then that of its best row.
    Items that fill no more than one block are sent to the queries as they are. Otherwise pivots are items drawn by hash,
    one per block of items and `PIVOTS` at most; they and one row per cell are all that reaches the driver.
    """
    schema = StructType([
        StructField(query, queries.schema[query].dataType), StructField(item, items.schema[item].dataType), StructField("score", DoubleType())])
    numbers = F.col(vector).cast("array<double>").alias("vector")
    asked = queries.select(F.col(query).alias("id"), numbers)
    held = cut(first_owners(items.select(F.col(item).alias("owner"), numbers), k + int(exclude_same)))
    size = held.count()
    n = max(1, min(PIVOTS, size // ITEM_ROWS)) if pivots is None else pivots
    order = [F.desc(F.round("score", 9)), F.asc(item)]

    def pooled(found: DataFrame) -> DataFrame:
        return best_per_group(found.groupBy(query, item).agg(F.max("score").alias("score")), [query], order, k)

    if pivots is None and 0 < size <= ITEM_ROWS:
        few = held.toArrow().combine_chunks()
        pool = Pool(_matrix(few.column("vector").combine_chunks()), few.column("owner").to_pylist())
        return pooled(_beside_pool(asked, pool, few.schema.field("owner").type, query, item, schema, k, exclude_same))
    drawn = held.orderBy(F.xxhash64("vector"), "vector").limit(n).collect()
    if not drawn:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    celled = cut(_celled(held, Cells(np.array([r.vector for r in drawn], float))))
    stats = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("angle").alias("angle"), F.max("length").alias("length")).collect()
    sizes, reach, widest, longest = (np.zeros(len(drawn)) for _ in range(4))
    for r in stats:
        sizes[r.cell], reach[r.cell], widest[r.cell], longest[r.cell] = r.n, r.far, r.angle, r.length
    cells = Cells(np.array([r.vector for r in drawn], float), reach, widest, longest)
    wanted = k + int(exclude_same)
    meet = partial(_products, query=query, item=item, schema=schema, k=k, exclude_same=exclude_same)
    places = celled.select("owner", "vector", "cell")
    found = meet(block_pairs(_meeting_cells(asked, cells, sizes, wanted, True), places))
    if len(stats) > 1:
        found = cut(found)
        least = pooled(found).groupBy(F.col(query).alias("id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == k)
        rest = _meeting_cells(asked.join(least.drop("_n"), "id", "left"), cells, sizes, wanted, False)
        found = found.unionByName(meet(block_pairs(rest.select("id", "vector", "cell"), places)))
    return pooled(found)


def unit(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors scaled to length 1."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("_norm", norm).withColumn(
        vector, F.transform(vector, lambda x: x / F.col("_norm"))).drop("_norm")
