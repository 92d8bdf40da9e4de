"""Trigram vectors against counts of all trigrams, one by one, without a lambda over all slots."""

import math
from collections import Counter

from pyspark.sql import functions as F

from talentgrid.functions import text as tx


def test_vectors_are_counts_of_trigram_slots(spark):
    made = ["data", "Data Engineer", "", "aaaaaaaa", "कौशल ज्ञान", "x" * 300 + "yz", None]
    texts = spark.createDataFrame([(t,) for t in made], "text string")
    padded = F.concat(F.lit("  "), F.lower("text"), F.lit("  "))
    slots = texts.filter("text is not null").select("text", F.explode(F.sequence(F.lit(1), F.length(padded) - 2)).alias("i")).select(
        "text", F.expr("cast(pmod(xxhash64(substring(concat('  ', lower(text), '  '), i, 3)), 256) as int)").alias("slot"))
    want = {}
    for r in slots.collect():
        want.setdefault(r.text, Counter())[r.slot] += 1
    vector = tx.trigram_vector(F.col("text"))
    got = {r.text: r.v for r in texts.select("text", vector.alias("v")).collect()}
    assert got.pop(None) == [None] * 256 and len(got) == len(want) == 6
    for text, counts in want.items():
        norm = math.sqrt(sum(n * n for n in counts.values()))
        assert len(got[text]) == 256 and all(abs(v - counts[d] / norm) < 1e-6 for d, v in enumerate(got[text]))
    plan = texts.select(vector.alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "array_contains" not in plan and "sequence(0, 255" not in plan
