"""Mixing of sources to target weights by hierarchical budgets.

Weights are given to the nodes of a tree whose levels are columns (domain, language, source). A node's budget goes to its
children by weight; a child that cannot use its share is filled up, and what it leaves goes to its siblings by weight.
Since no node gets more than its subtree can use, a shortage stays among siblings first and reaches an ancestor's
siblings only when the whole subtree is used up. Each leaf then takes whole epochs and a prefix, in tokens, of the next
one, in an order seeded by epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import broadcast_if_small, cut

NONE = "(none)"  # stands for a null level
ROOT = "_root"  # the key above the first level
PART_ROWS = 20_000  # documents of a leaf that are ranked together, about


def words(text: Column) -> Column:
    """Number of words between ASCII white space."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[ \t\n\x0B\f\r]+"))).cast("long")


def _filled(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`children` (keys, room, weight) with `share`: what each gets of its parent's `budget`, given per `keys` without the last."""
    up = list(keys[:-1])
    state = cut(children.join(parents, up).withColumn("full", F.lit(False)))
    while True:
        left = state.groupBy(*up).agg(
            (F.first("budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0))).alias("rest"),
            F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).alias("weights"))
        level = F.when(F.col("weights") > 0, F.greatest("rest", F.lit(0.0)) / F.col("weights")).otherwise(0.0)
        now = cut(state.join(left, up).withColumn("level", level).withColumn("fuller", F.col("full") | (F.col("room") <= F.col("level") * F.col("weight"))))
        changed = not now.filter("full <> fuller").isEmpty()
        if not changed:
            return now.select(*keys, F.when(F.col("full"), F.col("room")).otherwise(F.col("level") * F.col("weight")).alias("share"))
        state = now.select(*keys, "room", "weight", "budget", F.col("fuller").alias("full"))


def mixture(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], share: float, max_epochs: int = 1,
    seed: int = 1, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, the levels, n_tokens, copies (how often the mixture holds it; 0: not at all).

    `levels` names the tree's levels from the root down; `weights` gives nodes, as paths, their weight among their
    siblings, 1 if not given. The mixture gets `share` of all tokens, at most `max_epochs` copies of any document, and
    never more than a leaf's budget. Null levels are a node "(none)"; a null or blank text has no tokens and comes with its
    leaf's prefix. Rows that repeat an id are ordered by their tokens and, if alike, counted separately. An empty table gives an empty
    result; columns of `docs` that no argument names are not read.
    """
    spark, keys = docs.sparkSession, list(levels)
    base = cut(docs.select(
        F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()],
        (words(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens")))
    leaves = cut(base.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).withColumn(ROOT, F.lit(0)))
    budgets = leaves.groupBy(ROOT).agg((F.coalesce(F.sum("tokens"), F.lit(0)) * min(float(share), float(max_epochs))).alias("budget"))
    paths = [(*p, *[None] * (len(keys) - len(p)), float(w)) for p, w in weights.items()]
    given = spark.createDataFrame(paths, ", ".join(f"`{k}` string" for k in keys) + ", given double")
    for depth in range(1, len(keys) + 1):
        own = keys[:depth]
        listed = given.filter(F.col(own[-1]).isNotNull())
        listed = (listed.filter(F.col(keys[depth]).isNull()) if depth < len(keys) else listed).select(*own, "given")
        rooms = leaves.groupBy(ROOT, *own).agg((F.sum("tokens") * float(max_epochs)).alias("room"))
        nodes = rooms.join(listed, own, "left").withColumn("weight", F.coalesce("given", F.lit(1.0))).drop("given")
        budgets = _filled(nodes, budgets, [ROOT, *own]).withColumnRenamed("share", "budget")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-12)).otherwise(0).cast("long")
    targets = leaves.join(budgets, [ROOT, *keys]).drop(ROOT).withColumn("epochs", whole).withColumn(
        "rest", F.floor(F.col("budget") + 1e-6).cast("long") - F.col("epochs") * F.col("tokens"))
    rows = base.join(broadcast_if_small(targets), keys)
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    parts = F.ceil(F.col("rows") / PART_ROWS)
    place = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / 2.0**32 * parts).cast("long")
    rows = cut(rows.withColumn("turn", turn).withColumn("part", place).select("doc_id", *keys, "n_tokens", "epochs", "rest", "turn", "part"))
    sums = rows.groupBy(*keys, "part").agg(F.sum("n_tokens").alias("here"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0))))
    placed = rows.join(broadcast_if_small(sums), [*keys, "part"])
    one = [F.col("doc_id"), *[F.col(k) for k in keys], F.col("n_tokens")]
    all_in, all_out = F.col("before") + F.col("here") <= F.col("rest"), F.col("before") > F.col("rest")
    within = Window.partitionBy(*keys, "part").orderBy("turn", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.filter(~all_in & ~all_out).withColumn("taken", F.col("before") + F.sum("n_tokens").over(within))
    return placed.filter(all_in | all_out).select(*one, (F.col("epochs") + all_in.cast("long")).alias("copies")).unionByName(
        split.select(*one, (F.col("epochs") + (F.col("taken") <= F.col("rest")).cast("long")).alias("copies")))
