"""Reproducible samples by hash order: strata, subsets, hidden items, weighted draws and resampling weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.distributed import best_per_group, cumulative
from talentgrid.functions.numeric import hash_bucket, hash_order
from talentgrid.session import cut

MOST_CELLS = 1 << 16  # of [0, 1) in a draw by ranges


def mention_bands(df: DataFrame, key: str, weight: str, high: float = 0.5, mid: float = 0.8) -> DataFrame:
    """Band of each key by its place in the cumulative share of mentions, most mentioned first, key as tie-break.

    Totals of larger weights come from distinct weights; only the keys of equal weight are ranked among themselves, in
    buckets of their leading characters.
    """
    rows = df.withColumn("_neg", -F.col(weight))
    above = cumulative(rows, [], "_neg", weight=weight).select(
        "_neg", F.col("before").alias("_above"), F.col("total").alias("_total"))
    among = cumulative(rows, ["_neg"], key).select("_neg", key, F.col("before").alias("_earlier"))
    placed = rows.join(above, "_neg").join(among, ["_neg", key])
    share = (F.col("_above") + F.col(weight) * (F.col("_earlier") + 1)) / F.col("_total")
    band = F.when(share <= high, "high").when(share <= mid, "mid").otherwise("low")
    return placed.withColumn("mention_band", band).select(*df.columns, "mention_band")


def stratified_sample(df: DataFrame, key: str, stratum: str, weight: str, n: int, seed: str) -> DataFrame:
    """About n rows spread evenly over the strata, topped up by hash order, with stratum size and mentions.

    Every stratum gives n // strata rows (at least one); missing rows come from the rest of the table.
    """
    order = hash_order(F.col(key), seed)
    rows = df.withColumn("_order", order)
    sizes = df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("stratum_size"), F.sum(weight).alias("stratum_mentions"))
    per = max(1, n // max(1, sizes.count()))
    first = best_per_group(rows, [stratum], [F.asc("_order"), F.asc(key)], per, "_r")
    picked = first.select(key)
    short = n - picked.count()
    sample = rows.join(picked, key, "left_semi")
    if short > 0:
        rest = rows.join(picked, key, "left_anti").orderBy("_order", key).limit(short)
        sample = sample.unionByName(rest)
    taken = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled_in_stratum"))
    return sample.join(sizes, stratum).join(taken, stratum).drop("_order")


def banded_sample(df: DataFrame, key: str, band: Column, n: int, seed: str) -> DataFrame:
    """n // bands rows of every band by hash order, with band size."""
    rows = df.withColumns({"stratum": band, "_order": hash_order(F.col(key), seed)})
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_size"))
    per = n // max(1, sizes.count())
    picked = best_per_group(rows, ["stratum"], [F.asc("_order"), F.asc(key)], per, "_r").drop("_r", "_order")
    return picked.join(sizes, "stratum")


def similarity_band(score: Column) -> Column:
    """Right-closed similarity bands of the title sample."""
    return (
        F.when(score <= 0.5, "<0.50").when(score <= 0.6, "0.50-0.60").when(score <= 0.7, "0.60-0.70")
        .when(score <= 0.8, "0.70-0.80").otherwise("0.80+")
    )


def first_by_hash(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows with the smallest salted hash of their key."""
    return df.withColumn("_order", hash_order(F.col(key), seed)).orderBy("_order", key).limit(n).drop("_order")


def hide_items(edges: DataFrame, owner: str, item: str, held_out: DataFrame, seed: str, known_share: float = 0.5, min_items: int = 2) -> DataFrame:
    """Edges with status known or hidden: held-out owners with enough items keep ceil(share·n) by hash order.

    The order is found inside each owner's item set, which is as long as the owner's distinct items.
    """
    def salted(x: Column) -> Column:
        return hash_order(F.concat_ws(":", F.col(owner).cast("string"), x), seed)

    sets = edges.groupBy(owner).agg(F.collect_set(item).alias("_items"))
    marked = sets.join(held_out.select(owner).distinct().withColumn("_held", F.lit(True)), owner, "left")
    ordered = F.array_sort(F.transform("_items", lambda x: F.struct(salted(x).alias("o"), x.alias("x"))))
    known = F.ceil(F.size("_items") * known_share)
    hides = F.coalesce("_held", F.lit(False)) & (F.size("_items") >= min_items)
    long = marked.select(owner, known.alias("_known"), hides.alias("_hides"), F.posexplode(ordered).alias("_pos", "e"))
    return long.select(owner, F.col("e.x").alias(item), F.when(
        F.col("_hides") & (F.col("_pos") >= F.col("_known")), "hidden").otherwise("known").alias("status"))


def weighted_draw(df: DataFrame, keys: Sequence[str], item: str, weight: Column, seed: str, k: int) -> DataFrame:
    """k items per key without replacement, drawn in proportion to weight by exponential hash keys."""
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in keys], F.col(item).cast("string"))
    uniform = (hash_bucket(name, seed, 1 << 31) + 0.5) / float(1 << 31)
    return best_per_group(df.withColumn("_draw", -F.log(uniform) / weight), keys, [F.asc("_draw"), F.asc(item)], k).drop("_draw")


def uniform(seed: str, *parts: Column | str) -> Column:
    """A number strictly between 0 and 1 from the hash of the parts."""
    return (hash_bucket(F.concat_ws(":", *parts), seed, 1 << 31) + 0.5) / float(1 << 31)


def weight_ranges(items: DataFrame, item: str, weight: str) -> DataFrame:
    """(item, low, high): the stretch of [0, 1) that each item holds in proportion to its weight, in the order of items."""
    ranked = cumulative(items.filter(F.col(weight) > 0), [], item, weight=weight)
    return ranked.select(item, (F.col("before") / F.col("total")).alias("low"), ((F.col("before") + F.col("n")) / F.col("total")).alias("high"))


def inverse_draw(points: DataFrame, ranges: DataFrame, item: str, at: str = "u") -> DataFrame:
    """`points` with the item whose range holds the point's number `at` in [0, 1); `ranges` come from `weight_ranges`.

    Both sides meet by cell of [0, 1), of which there are as many as items: a range lies in the cells it touches, so the
    join emits about two rows per point, and neither a heavy item nor a large vocabulary meets in one task.
    """
    held = cut(ranges)
    cells = F.lit(max(1, min(held.count(), MOST_CELLS)))
    last = F.least(F.ceil(F.col("high") * cells) - 1, cells - 1)
    spread = held.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.greatest(last, F.floor(F.col("low") * cells)))))
    placed = points.withColumn("_cell", F.floor(F.col(at) * cells))
    return placed.join(spread, "_cell").filter((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).select(*points.columns, item)


def foreign_draw(
    takers: DataFrame, owned: DataFrame, items: DataFrame, key: str, item: str, weight: str, n: int, seed: str, tries: int = 4, rounds: int = 12
) -> DataFrame:
    """n items per taker that it does not own, drawn one after another in proportion to weight without replacement: (key, item).

    Each try draws from all items and counts unless the item is owned or drawn already, which gives the same chances as
    drawing from what is left. Takers that are still short try twice as often in the next round; the few that own nearly
    all weight and miss in every round take the heaviest items they lack. A taker that lacks fewer than n items gets all.
    """
    items = items.filter(F.col(weight) > 0).select(item, weight)
    ranges = cut(weight_ranges(items, item, weight))
    size = ranges.count()
    own = owned.select(key, item).join(items.select(item), item).groupBy(key).agg(F.countDistinct(item).alias("_own"))
    short = cut(takers.select(key).distinct().join(own, key, "left").select(
        key, F.coalesce("_own", F.lit(0)).alias("_own"), F.least(F.lit(n), size - F.coalesce("_own", F.lit(0))).alias("_need")).filter("_need > 0"))
    drawn, first = short.select(key, F.lit(None).cast(dict(items.dtypes)[item]).alias(item), F.lit(0).alias("_try")).limit(0), 0
    for _ in range(rounds):
        attempts = short.select(key, F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))).alias("_try")).withColumn(
            "u", uniform(seed, F.col(key).cast("string"), F.col("_try").cast("string")))
        fresh = inverse_draw(attempts, ranges, item).join(owned.select(key, item).distinct(), [key, item], "left_anti")
        drawn = cut(drawn.unionByName(fresh.select(key, item, "_try")).groupBy(key, item).agg(F.min("_try").alias("_try")))
        have = drawn.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
        short = cut(short.join(have, key, "left").filter(F.coalesce("_have", F.lit(0)) < F.col("_need")).select(key, "_own", "_need"))
        if short.isEmpty():
            break
        first, tries = first + tries, 2 * tries
    else:
        # Of its number of items and n more, the heaviest, a taker lacks at least n.
        heaviest = cumulative(items.select(F.struct((-F.col(weight)).alias("w"), item).alias("_i")), [], "_i").select(F.col("before").alias("_at"), F.col(f"_i.{item}").alias(item))
        late = short.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own") + n - 1)).alias("_at")).join(heaviest, "_at").join(
            owned.select(key, item).distinct(), [key, item], "left_anti").join(drawn.select(key, item), [key, item], "left_anti")
        drawn = drawn.unionByName(late.select(key, item, (F.lit(first) + F.col("_at")).cast("int").alias("_try")))
    return best_per_group(drawn, [key], [F.asc("_try")], n).select(key, item)


def _poisson_draws(df: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """One row per (unit, replicate) with a Poisson(1) weight, zero or more.

    Units are few bytes beside the rows they make, so their tasks are not merged by size.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(tasks).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    uniform = (hash_bucket(F.concat_ws(":", "rep", F.col(unit).cast("string")), seed, 1 << 31) + 0.5) / float(1 << 31)
    limits, p, total = [], 0.36787944117144233, 0.0
    for i in range(9):
        total += p
        limits.append(total)
        p /= i + 1
    weight = F.lit(9)
    for i in reversed(range(9)):
        weight = F.when(F.col("_u") < limits[i], i).otherwise(weight)
    return rows.withColumn("_u", uniform).withColumn("w", weight).drop("_u")


def poisson_weights(df: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """Resampling weights: one row per (unit, replicate) with a Poisson(1) weight above zero.

    Pass pre-aggregated units (queries or clusters): the output has about 0.63 · replicates rows per unit.
    """
    return _poisson_draws(df, unit, replicates, seed).filter("w > 0")


def bootstrap_ratio(units: DataFrame, unit: str, numerator: str, denominator: str, keys: Sequence[str] = (), replicates: int = 200,
                    seed: str = "boot:") -> DataFrame:
    """95 % percentile interval of a ratio of sums, resampling whole units, per key."""
    from talentgrid.functions.distributed import exact_quantiles

    # Rows of weight zero are passed over in the sums: a filter on the weight would hash every draw again.
    drawn = _poisson_draws(units, unit, replicates, seed)
    total = lambda name: F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(name)))
    values = drawn.groupBy(*keys, "rep").agg(F.try_divide(total(numerator), total(denominator)).alias("_ratio"))
    return exact_quantiles(values, list(keys), "_ratio", {"low": 0.025, "high": 0.975})


def synthetic_candidates(
    n: int, occupations: DataFrame, requirements: DataFrame, popular: DataFrame, vocabulary: DataFrame, postings: DataFrame, seed: str
) -> DataFrame:
    """n candidates flagged synthetic, with an occupation drawn by demand and skills drawn per occupation.

    `occupations(occupation, demand)`, `requirements(occupation, skill_id, relation)`, `popular(occupation, skill_id)` the top
    posting skills, `vocabulary(skill_id)` for two random extra skills, `postings(occupation, job_id, state, tier, exp_band)`.
    """
    spark = occupations.sparkSession
    chance = partial(uniform, seed)
    eligible = occupations.filter(F.col("demand") >= 5)
    people = inverse_draw(
        spark.range(n).select(F.col("id").cast("string").alias("i")).withColumn("u", chance(F.lit("occ"), "i")),
        weight_ranges(eligible, "occupation", "demand"), "occupation").select("i", "occupation")
    chances = requirements.select("occupation", "skill_id", F.when(F.col("relation") == "essential", 0.5).otherwise(0.15).alias("p")).unionByName(
        popular.select("occupation", "skill_id", F.lit(0.5).alias("p"))).groupBy("occupation", "skill_id").agg(F.max("p").alias("p"))
    drawn = people.join(chances, "occupation").filter(chance(F.lit("skill"), "i", "skill_id") < F.col("p")).select("i", "skill_id")
    slots = vocabulary.agg(F.count(F.lit(1)).alias("v")).scalar()
    numbered = cumulative(vocabulary, [], "skill_id").select("skill_id", F.col("before").alias("slot"))
    extra = people.select("i", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x")).withColumn(
        "slot", F.floor(chance(F.lit("extra"), "x", "i") * slots)).join(numbered, "slot").select("i", "skill_id")
    skills = drawn.unionByName(extra).groupBy("i").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    sizes = postings.groupBy("occupation").agg(F.count(F.lit(1)).alias("size"))
    ranked = cumulative(postings, ["occupation"], "job_id").select("occupation", "job_id", F.col("before").alias("slot"))
    homes = people.join(sizes, "occupation").withColumn("slot", F.floor(chance(F.lit("home"), "i") * F.col("size"))).join(
        ranked, ["occupation", "slot"]).join(postings.drop("occupation"), "job_id").select("i", "occupation", "state", "tier", "exp_band")
    return homes.join(skills, "i").select(
        F.concat(F.lit("SYN-"), F.lpad("i", 8, "0")).alias("candidate_id"), F.lit(True).alias("synthetic"), "occupation", "skills",
        "state", "tier", "exp_band")
