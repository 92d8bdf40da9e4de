"""Weighted draws by ranges against the plain draw over one list."""

from collections import Counter, defaultdict
import hashlib
import random

from pyspark.sql import functions as F

from talentgrid.operators import sampling as sm


def uniform(seed, *parts):
    return (int(hashlib.sha256((seed + ":".join(map(str, parts))).encode()).hexdigest()[:8], 16) % (1 << 31) + 0.5) / (1 << 31)


def pick(weights, u):
    total, before = sum(weights.values()), 0
    for item in sorted(weights):
        if before / total <= u < (before + weights[item]) / total:
            return item
        before += weights[item]


def test_each_point_gets_the_item_of_its_range(spark):
    rng = random.Random(1)
    weights = {f"i{i:03d}": rng.choice([1, 2, 5000]) for i in range(300)}
    items = spark.createDataFrame([*weights.items(), ("none", 0)], "item string, w long")
    points = spark.createDataFrame([(i, rng.random()) for i in range(3000)] + [(-1, 0.0), (-2, 1 - 2**-53)], "id long, u double")
    got = {r.id: r.item for r in sm.inverse_draw(points, sm.weight_ranges(items, "item", "w"), "item").collect()}
    assert got == {r.id: pick(weights, r.u) for r in points.collect()}
    one = sm.inverse_draw(points, sm.weight_ranges(items.limit(1), "item", "w"), "item")
    assert one.count() == points.count()


def test_foreign_items_are_drawn_in_turn(spark):
    rng = random.Random(2)
    weights = {f"s{i:02d}": 1 + i * i for i in range(40)}
    owned = [(t, s) for t in range(200) for s in rng.sample(sorted(weights), rng.randint(1, 12))]
    owned += [(900, s) for s in weights if s != "s00"] + [(901, s) for s in weights] + [(902, s) for s in weights if s not in ("s00", "s01", "s02")]
    takers = spark.createDataFrame([(t,) for t in [*range(201), 900, 901, 902, 902]], "t long")
    frames = spark.createDataFrame(owned, "t long, s string"), spark.createDataFrame(list(weights.items()), "s string, w long")
    rows = sm.foreign_draw(takers, *frames, "t", "s", "w", 2, "d:", rounds=3)
    got = defaultdict(list)
    for r in rows.collect():
        got[r.t].append(r.s)
    has = defaultdict(set)
    for t, s in owned:
        has[t].add(s)
    for t in [*range(201)]:
        want, tried = [], 0
        while len(want) < 2:
            item, tried = pick(weights, uniform("d:", t, tried)), tried + 1
            if item not in has[t] and item not in want:
                want.append(item)
        if tried <= 28:
            assert sorted(got[t]) == sorted(want)
    assert got[900] == ["s00"] and got[901] == [] and len(set(got[902])) == 2 and set(got[902]) <= {"s00", "s01", "s02"}
    assert len(got[200]) == 2


def test_heavy_items_are_drawn_more_often(spark):
    items = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "s string, w long")
    takers = spark.range(4000).withColumnRenamed("id", "t")
    none = spark.createDataFrame([], "t long, s string")
    share = Counter(r.s for r in sm.foreign_draw(takers, none, items, "t", "s", "w", 1, "x:").collect())
    assert abs(share["a"] / 4000 - 0.6) < 0.03 and abs(share["b"] / 4000 - 0.3) < 0.03
