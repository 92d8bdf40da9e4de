"""What one task scores and ranks stays bounded, however many pairs there are."""

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import recommend as rec
from tests.test_search import market


@pytest.mark.parametrize("score", [rec.adamic_adar, rec.tfidf_cosine])
def test_scores_of_many_pairs_are_dealt_to_many_tasks(spark, monkeypatch, score):
    queries, edges, stats = market(spark)
    rows = lambda df: sorted((r.query_id, r.job_id, round(r.score, 9)) for r in df.collect())
    want = rows(score(queries, edges, stats))
    monkeypatch.setattr(rec, "PAIRS_PER_TASK", 500, raising=False)
    got = score(queries, edges, stats)
    assert rows(got) == want
    most = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert most <= 2 * 500 < len(want) / 4
