from pyspark.sql import functions as F

from talentgrid.operators import recommend as rec


def test_skills_of_roles_come_from_counted_demand(spark):
    postings = spark.createDataFrame([(j, f"o{j % 3}") for j in range(30)], "job_id long, occupation string")
    edges = spark.createDataFrame([(j, f"s{(j * k) % 11:02d}") for j in range(30) for k in (1, 2, 3)], "job_id long, skill_id string").distinct()
    queries = spark.createDataFrame([("q", "s00"), ("q", "s03"), ("r", "s05")], "query_id string, skill_id string")
    roles = spark.createDataFrame([("q", "o0"), ("q", "o2"), ("r", "o0")], "query_id string, occupation string")
    needs = spark.createDataFrame([("o0", "s03", "essential"), ("o0", "s05", "optional")], "occupation string, skill_id string, relation string")
    demand = edges.join(postings, "job_id").groupBy("occupation", "skill_id").agg(F.count(F.lit(1)).alias("postings"))
    got = rec.role_skills(roles, queries, None, None, needs, demand=demand)
    assert sorted(map(str, got.collect())) == sorted(map(str, rec.role_skills(roles, queries, edges, postings, needs).collect()))
