"""Connected components of links by distributed union-find: sets hook onto smaller ones, paths are halved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.session import cut, release

ONE_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected links (a, b); the root is the smallest node of its component.

    Every node points at a smaller one of its set. In a round each set that a link joins with another hooks onto the
    smallest one it meets, and every node then points where that one points. Minima combine before they are shuffled,
    however many links one node has, and a round is written out once. Links of a node with itself count as none. Up to
    ONE_TASK links are joined in one task, as shuffles of each round would take longer and keep the driver busy.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = edges.limit(ONE_TASK + 1).count() <= ONE_TASK
    here = lambda df: df.coalesce(1) if few else df
    both = here(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    sets = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        held = here(sets)
        end = lambda c, sets=held: sets.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        meets = here(edges).join(end("a"), "a").join(end("b"), "b").filter("root_a <> root_b")
        hooks = meets.groupBy(F.greatest("root_a", "root_b").alias("root")).agg(F.min(F.least("root_a", "root_b")).alias("onto"))
        hooked = held.join(hooks, "root", "left").select("node", F.col("root").alias("was"), F.coalesce("onto", "root").alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        halved = cut(hooked.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("was")).alias("moved")))
        release(sets)
        sets = halved
        if sets.filter("moved").isEmpty():
            release(edges)
            return sets.select("node", "root")
