"""Logical tables (postings, skills, taxonomy, profiles) bound to the star-schema test tables.

Another deployment replaces this module with its own readers; the operators only see the logical tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.distributed import best_per_group
from talentgrid.session import cut

PROFILE_SIZE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Bound:
    """Lazily built logical tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def places(self) -> DataFrame:
        """state, region and tier per nation key."""
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"),
            (1 + F.col("n_regionkey") % 3).cast("int").alias("tier"),
        )

    @property
    def postings(self) -> DataFrame:
        orders, customer = self.raw("orders"), self.raw("customer")
        priority = F.col("o_orderpriority")
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("job_id"),
                F.concat_ws(" ", priority, "c_mktsegment").alias("title"),
                F.col("c_name").alias("company"),
                F.col("o_orderdate").cast("date").alias("posted_date"),
                "state", "region", "tier",
                F.when(priority == "1-URGENT", "0-1").when(priority == "2-HIGH", "1-3")
                .when(priority == "3-MEDIUM", "3-6").when(priority == "4-NOT SPECIFIED", "6-10")
                .otherwise("10+").alias("exp_band"),
                F.when(priority == "1-URGENT", 0).when(priority == "2-HIGH", 1).when(priority == "3-MEDIUM", 3)
                .when(priority == "4-NOT SPECIFIED", 6).otherwise(10).alias("exp_min"),
                F.concat_ws("|", "c_mktsegment", priority).alias("occupation"),
                F.col("c_mktsegment").alias("isco2"),
                F.col("o_totalprice").alias("pay"),
                (F.col("o_orderstatus") != "P").alias("disclosed"),
                F.col("o_custkey").alias("company_id"),
            )
        )

    @property
    def raw_postings(self) -> DataFrame:
        """Scraped posting rows, all text, with repeated ids: completed orders are listed twice."""
        orders, customer = self.raw("orders"), self.raw("customer")
        line, part = self.raw("lineitem"), self.raw("part")
        ordered = F.array_sort(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.upper("p_name").alias("tag"))))
        tags = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(
            F.array_join(F.transform(ordered, lambda s: s["tag"]), " , ").alias("tagsAndSkills"))
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        pay = F.floor("o_totalprice").cast("long")
        years = F.substring(priority, 1, 1).cast("int") * 2
        age = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
        copies = F.when(status == "F", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(tags, orders.o_orderkey == tags.l_orderkey, "left")
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("copy", F.explode(copies))
            .select(
                (F.col("o_orderkey") * 2 + F.col("copy")).alias("row_no"),
                F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "ddMMyy"),
                         F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("jobId"),
                F.when(F.col("c_acctbal") < 0, " ").otherwise(F.concat_ws(" ", priority, "c_mktsegment")).alias("title"),
                F.col("c_name").alias("companyName"), "tagsAndSkills",
                F.when(F.col("c_mktsegment") == "MACHINERY", "USD").otherwise("INR").alias("currency"),
                F.when(F.col("copy") == 1, "Just Now")
                .otherwise(F.concat(age.cast("string"), F.lit(" Days Ago"))).alias("jobUploaded"),
                F.when(status == "P", "0").otherwise(pay.cast("string")).alias("minimumSalary"),
                F.when(F.col("c_acctbal") > 5000, "0")
                .when(F.col("c_mktsegment") == "BUILDING", F.floor(pay / 2).cast("string"))
                .otherwise((pay + 20000).cast("string")).alias("maximumSalary"),
                years.cast("string").alias("minimumExperience"),
                F.when(status == "O", "").otherwise((6 - years).cast("string")).alias("maximumExperience"),
                F.floor(F.col("c_acctbal") / 1500).cast("string").alias("AggregateRating"),
                F.col("o_custkey").cast("string").alias("ReviewsCount"),
                F.concat("state", F.when(status == "P", " / Remote").otherwise("")).alias("location"),
            )
        )

    @cached_property
    def job_skill(self) -> DataFrame:
        """Distinct posting-skill edges, kept for the query that uses them several times.

        Repeats are dropped map-side, so a posting with very many lines arrives as its distinct skills in one shuffle; the edges
        then stay partitioned by posting and later groupings and joins that include job_id need no further shuffle.
        """
        line, part = self.raw("lineitem"), self.raw("part")
        edges = line.join(part, line.l_partkey == part.p_partkey).select(
            F.col("l_orderkey").alias("job_id"), F.concat_ws("|", "p_brand", "p_type").alias("skill_id"))
        sets = edges.groupBy("job_id").agg(F.collect_set("skill_id").alias("skills"))
        return sets.select("job_id", F.explode("skills").alias("skill_id")).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def job_tag(self) -> DataFrame:
        line, part = self.raw("lineitem"), self.raw("part")
        return (
            line.join(part, line.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("job_id"), F.col("p_name").alias("tag"))
            .distinct()
        )

    @property
    def skill_field(self) -> DataFrame:
        """Broad field and group of each skill."""
        return self.raw("part").select(
            F.concat_ws("|", "p_brand", "p_type").alias("skill_id"), F.col("p_type").alias("field"),
            F.col("p_brand").alias("skill_group"),
        ).distinct()

    @cached_property
    def occupation_demand(self) -> DataFrame:
        """Postings per (occupation, skill); a small table of the taxonomy's size, written once per query."""
        return cut(
            self.postings.select("job_id", "occupation").join(self.job_skill, "job_id")
            .groupBy("occupation", "skill_id").agg(F.count(F.lit(1)).alias("postings"))
        )

    @property
    def profiles(self) -> DataFrame:
        """One profile per occupation: the skills its postings list most often."""
        best = best_per_group(
            self.occupation_demand, ["occupation"], [F.desc("postings"), F.asc("skill_id")], PROFILE_SIZE
        )
        return best.select(F.col("occupation").alias("query_id"), "skill_id")

    @property
    def requirements(self) -> DataFrame:
        """Occupation-skill edges of the taxonomy: the 30 most listed skills, the first 12 of them essential."""
        best = best_per_group(self.occupation_demand, ["occupation"], [F.desc("postings"), F.asc("skill_id")], 30)
        return best.select(
            "occupation", "skill_id", F.when(F.col("rank") <= 12, "essential").otherwise("optional").alias("relation")
        )
