"""Order statistics, running totals, dense numbers and item pairs that never put one whole group in one task.

A key may hold a third of all rows, and its values may share a prefix or lie in a narrow range. Everything here first
collapses rows to (key, value, count) with map-side combining, then sorts them into ranges of about equal size, whose
bounds Spark samples from the data. A window only ever sees the short list of ranges of a key or the rows of one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import cut


def _collapse(df: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    """(keys, value, n) with the number of the range that each row fell into, written out since ranges are drawn once."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, value).agg(amount.alias("n"))
    return cut(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))


def _range_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_in_range"))
        .select(
            *keys,
            "_range",
            "_in_range",
            F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_in_range").over(per_key).alias("total"),
        )
    )


def _join_offsets(counts: DataFrame, offsets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    within = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(offsets, [*keys, "_range"]).select(
        *keys,
        value,
        "n",
        (F.col("_offset") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"),
        "total",
    )


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, value): its weight `n`, the weight `before` it among smaller values, and the key's `total`.

    Keys and value must not be null.
    """
    counts = _collapse(df, keys, value, weight)
    return _join_offsets(counts, _range_offsets(counts, keys), keys, value)


def dense_numbers(df: DataFrame, value: str, name: str, limit: int | None = None) -> DataFrame:
    """Distinct values with numbers 0, 1, 2 ... in an order of their own; raises if there are more than `limit`."""
    numbered = cut(df.select(value).distinct().withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the data.
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    if limit is not None and numbered.count() > limit:
        raise ValueError(f"more than {limit} values of {value}")
    return numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        value, (F.coalesce("_start", F.lit(0)) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of `probs`; nulls in `value` are ignored.

    Only the ranges that hold a wanted rank are ranked row by row.
    """
    counts = _collapse(df.filter(F.col(value).isNotNull()), keys, value, weight)

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("total") - 1)

    def holds(start: Column, size: Column, position: Column) -> Column:
        return (start <= position) & (position < start + size)

    wanted = F.lit(False)
    for p in probs.values():
        for end in (F.floor(rank(p)), F.ceil(rank(p))):
            wanted = wanted | holds(F.col("_offset"), F.col("_in_range"), end)
    offsets = _range_offsets(counts, keys).filter(wanted)
    ranked = _join_offsets(counts, offsets, keys, value)
    picks = []
    for name, p in probs.items():
        low, high = F.floor(rank(p)), F.ceil(rank(p))
        at_low = F.max(F.when(holds(F.col("before"), F.col("n"), low), F.col(value)))
        at_high = F.max(F.when(holds(F.col("before"), F.col("n"), high), F.col(value)))
        picks.append((at_low + (at_high - at_low) * F.max(rank(p) - low)).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles under positive real weights per key, one column per entry of `probs`; rows without value or weight are ignored.

    A value stands at the middle of its weight, at (weight before it + half its own) / total; quantiles between two values
    are interpolated linearly, and outside the first and the last one they are these.
    """
    places = cumulative(df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)), keys, value, weight=weight).withColumn(
        "_at", (F.col("before") + F.col("n") / 2) / F.col("total"))
    here = F.struct("_at", F.col(value).alias("v"))
    ends = []
    for name, p in probs.items():
        ends += [F.max(F.when(F.col("_at") <= p, here)).alias(f"_low_{name}"), F.min(F.when(F.col("_at") >= p, here)).alias(f"_high_{name}")]
    found = places.groupBy(*keys).agg(*ends)

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        inside = low["v"] + (high["v"] - low["v"]) * F.coalesce(F.try_divide(F.lit(p) - low["_at"], high["_at"] - low["_at"]), F.lit(0.0))
        return F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(inside).alias(name)

    return found.select(*keys, *[between(name, p) for name, p in probs.items()])


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, position: Column, name: str) -> DataFrame:
    """The value at a zero-based `position`, an expression over the per-key `total`; null when out of range."""
    ranked = cumulative(df.filter(F.col(value).isNotNull()), keys, value)
    hit = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(hit, F.col(value))).alias(name), F.max("total").alias("n_values")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value) with `n`, `total` and the shared (average) rank of tied rows, starting at 1."""
    return cumulative(df, keys, value).withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2)


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per key in a total order; Spark limits each map task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a total order."""
    return best_per_group(df, keys, order, 1, "_pick").drop("_pick")


def listed_once(df: DataFrame, keys: Sequence[str], last: bool = False) -> DataFrame:
    """The first or last listed row per key; copies merge map-side.

    "Listed" is the order of partitions and rows within them: that of the lines for a frame read from one file, and file by
    file for several. After a shuffle it means nothing, and rows of one key must then be alike.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = F.max_by if last else F.min_by
    kept = df.withColumn("_at", F.monotonically_increasing_id()).groupBy(*keys).agg(pick(F.struct(*rest), "_at").alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def item_sets(edges: DataFrame, owner: str, item: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per owner with its distinct items sorted; partial sets are merged, so repeats never travel."""
    return edges.groupBy(owner, *extra).agg(F.array_sort(F.collect_set(item)).alias("items"))


def item_pairs(sets: DataFrame, keep: Sequence[str] = (), slice_size: int = 256) -> DataFrame:
    """Unordered item pairs (a < b) of every set row, without a self-join.

    A set of at most `slice_size` items is paired where it is. A longer one is first cut into pairs of slices that are dealt
    out to tasks, so the work of one long set is shared. Filter the sets to frequent items first where the operator has a
    support threshold.
    """
    n = F.size("items")
    short = sets.filter((n > 1) & (n <= slice_size)).select(*keep, "items", F.posexplode("items").alias("_pos", "a")).select(
        *keep, "a", F.explode(F.slice("items", F.col("_pos") + 2, F.size("items"))).alias("b"))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(slice_size))
    first = sets.filter(n > slice_size).select(*keep, "items", F.explode(starts).alias("_start"))
    # A slice meets what follows it slice by slice, so that no row carries more than two slices and tasks share a long set.
    cut_set = lambda start: F.slice("items", F.col(start) + 1, F.lit(slice_size))
    second = first.select(*keep, cut_set("_start").alias("_left"), "_start", "items", F.explode(
        F.sequence(F.col("_start"), n - 1, F.lit(slice_size))).alias("_next"))
    spread = second.select(*keep, "_left", cut_set("_next").alias("_right"), (F.col("_start") == F.col("_next")).alias("_same"))
    spread = spread.repartition(F.xxhash64("_left", "_right"))
    left = spread.select(*keep, "_right", "_same", F.posexplode("_left").alias("_pos", "a"))
    tail = F.when(F.col("_same"), F.slice("_right", F.col("_pos") + 2, F.size("_right"))).otherwise(F.col("_right"))
    return short.unionByName(left.select(*keep, "a", F.explode(tail).alias("b")))
