"""How often operators read their inputs, and that what they save does not change results."""

import math

import pytest

from talentgrid.functions import text as tx
from talentgrid.functions.vectors import nearest
from talentgrid.operators import extraction as ex
from talentgrid.operators.linking import concept_labels


def counted(spark, df):
    """`df` and an accumulator of the rows read from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_texts_are_read_once_for_spans_and_once_for_phrases(spark):
    docs = spark.createDataFrame([(1, "python, data mining, कखग"), (2, "कखग घङच, कखगघ घङच"), (3, "sql and data minings"), (4, None)], "doc_id long, text string")
    dictionary = spark.createDataFrame([("python", "u1"), ("data mining", "u2"), ("sql", "u3")], "key string, uri string")
    labels = concept_labels(spark.createDataFrame([("u2", "data mining", []), ("u3", "sql", [])], "uri string, preferred string, alternates array<string>"))
    lexicon = spark.createDataFrame([("घङच", "sql")], "term string, english string")
    read, seen = counted(spark, docs)
    skills, _ = ex.extract_skills(read, dictionary, labels, lexicon, 0.7)
    got = {(r.doc_id, r.uri, r.method) for r in skills.collect()}
    assert got == {(1, "u1", "exact"), (1, "u2", "exact"), (2, "u3", "transliteration"), (3, "u3", "exact"), (3, "u2", "embedding")}
    assert seen.value <= 2 * 4


def test_few_items_do_not_make_queries_shuffle_and_are_the_same_as_in_cells(spark):
    rows = [(f"q{i}", [math.cos(i), math.sin(i), 0.1 * (i % 7)]) for i in range(300)]
    queries, seen = counted(spark, spark.createDataFrame(rows, "query_id string, vector array<double>"))
    items = spark.createDataFrame([(f"i{i % 40}", [math.cos(3 * i), math.sin(3 * i), 0.2]) for i in range(90)], "item_id string, vector array<double>")
    got = [tuple(r) for r in nearest(queries, items, 3).orderBy("query_id", "rank").collect()]
    assert seen.value == 300
    celled = [tuple(r) for r in nearest(queries, items, 3, pivots=5).orderBy("query_id", "rank").collect()]
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in celled]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in celled])


def test_trigram_vector_by_enumeration(spark):
    texts = ["", "a", "Data  Mining", "aaaaaaaaaa", "कखग"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "concat('  ', lower(t), '  ') AS p").selectExpr(
        "t", "transform(sequence(1, length(p) - 2), i -> cast(pmod(xxhash64(substring(p, i, 3)), 256) AS int)) AS slots")
    for r in df.withColumn("v", tx.trigram_vector(df["t"])).collect():
        norm = math.sqrt(sum(r.slots.count(d) ** 2 for d in range(256)))
        assert r.v == pytest.approx([r.slots.count(d) / norm for d in range(256)], rel=1e-6)
