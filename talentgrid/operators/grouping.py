"""Connected groups of rows that share keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.text import normal
from talentgrid.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest connected node per node of undirected (a, b) edges: (node, root).

    Alternating large-star and small-star steps: every step links neighbours to the smallest one, so path lengths halve and
    a hub never emits pairs of its neighbours. Minima are combined map-side, and each round is written out.
    """
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(smallest, "hi")
        current = cut(
            linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(linked.select("hi", F.col("m").alias("lo")))
            .filter("hi <> lo").distinct())
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("groups did not settle; raise max_rounds")
    return current.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def connected_groups(rows: DataFrame, row_key: str, keys: Sequence[Sequence[str]], member_digest: bool = False) -> DataFrame:
    """Rows with `group_id`: rows that share any non-blank key set, directly or through others, share a group.

    Copies collapse first: the graph is built over distinct key values, not rows. The id is the digest of the group's
    smallest row key, which combines map-side for a group of any size; `member_digest` uses the digest of all sorted row
    keys instead and gathers them, for small groups only.
    """
    named = rows
    columns = []
    for i, parts in enumerate(keys):
        values = [normal(F.col(c).cast("string")) for c in parts]
        blank = F.length(F.concat(*values)) == 0
        columns.append(f"_k{i}")
        named = named.withColumn(f"_k{i}", F.when(~blank, F.concat(F.lit(f"{i}:"), F.to_json(F.array(*values)))))
    named = named.withColumn("_first", F.coalesce(*columns, F.concat(F.lit("row:"), F.col(row_key))))
    links = named.select("_first", F.explode(F.array_compact(F.array(*columns))).alias("b")).distinct()
    roots = components(links.select(F.col("_first").alias("a"), "b"))
    placed = named.join(roots.withColumnRenamed("node", "_first"), "_first", "left").withColumn("_root", F.coalesce("root", "_first"))
    if member_digest:
        ids = placed.groupBy("_root").agg(F.array_join(F.array_sort(F.collect_list(row_key)), "|").alias("_id"))
    else:
        ids = placed.groupBy("_root").agg(F.min(row_key).alias("_id"))
    return placed.join(ids.withColumn("group_id", F.substring(F.sha2("_id", 256), 1, 20)), "_root").select(*rows.columns, "group_id")
