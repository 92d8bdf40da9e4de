"""Cleaning of scraped postings: ids, tags, dates, experience, pay, near-duplicate groups, and their audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.functions import text as tx
from talentgrid.functions.distributed import pick_one

# Plausible annual pay.
PAY_FLOOR = 50_000.0
PAY_CEILING = 50_000_000.0


def drop_repeated_ids(df: DataFrame, key: str = "jobId", order: str = "row_no") -> DataFrame:
    """Keep the first row of every id in the input order carried by `order`."""
    return pick_one(df, [key], [F.asc(order)])


def near_duplicate_group(company: Column, title: Column, tags: Column) -> Column:
    """Shared id of postings with the same company, normalised title and tag set."""
    key = F.concat_ws(
        "|", F.trim(F.lower(F.coalesce(company, F.lit("")))), tx.normalize_title(title),
        F.array_join(F.array_sort(tags), ","),
    )
    return F.substring(F.sha1(key), 1, 16)


def with_experience(df: DataFrame) -> DataFrame:
    low = F.col("minimumExperience").try_cast("double")
    high = F.col("maximumExperience").try_cast("double")
    swapped = low > high
    return df.withColumns({
        "exp_min": F.when(swapped, high).otherwise(low),
        "exp_max": F.when(swapped, low).otherwise(high),
    }).withColumn("exp_band", num.experience_band(F.col("exp_min")))


def with_pay(df: DataFrame, usd_policy: str = "exclude", usd_rate: float | None = None) -> DataFrame:
    """Annual pay range, midpoint and a flag; dollar rows are excluded or converted at `usd_rate`."""
    if usd_policy not in ("exclude", "convert"):
        raise ValueError("usd_policy must be 'exclude' or 'convert'")
    if usd_policy == "convert" and not usd_rate:
        raise ValueError("convert needs usd_rate")

    def positive(name: str) -> Column:
        value = F.col(name).try_cast("double")
        return F.when(value > 0, value)

    low, high = positive("minimumSalary"), positive("maximumSalary")
    listed = df.withColumns({
        "_lo": F.coalesce(low, high), "_hi": F.coalesce(high, low),
        "_usd": F.upper(F.coalesce("currency", F.lit(""))) == "USD",
    })
    factor = F.when(F.col("_usd"), F.lit(usd_rate) if usd_policy == "convert" else F.lit(None).cast("double")).otherwise(1.0)
    ranged = listed.withColumn("_usd_paid", F.col("_usd") & F.col("_lo").isNotNull()).withColumns({
        "_a": F.col("_lo") * factor, "_b": F.col("_hi") * factor,
    })
    ordered = ranged.withColumns({
        "pay_swapped": F.coalesce(F.col("_a") > F.col("_b"), F.lit(False)),
        "_min": F.least("_a", "_b"), "_max": F.greatest("_a", "_b"),
    })
    outside = F.col("_min").isNotNull() & ((F.col("_min") < PAY_FLOOR) | (F.col("_max") > PAY_CEILING))
    marked = ordered.withColumn("_implausible", outside)
    usd_flag = "currency_suspect" if usd_policy == "exclude" else "converted_from_usd"
    kept_min, kept_max = (F.when(~F.col("_implausible"), F.col(c)) for c in ("_min", "_max"))
    flag = (
        F.when(F.col("_implausible"), "implausible").when(F.col("_usd_paid"), usd_flag)
        .when(kept_min.isNotNull(), "ok").otherwise("not_disclosed")
    )
    return marked.withColumns({
        "salary_min_inr": kept_min, "salary_max_inr": kept_max, "salary_mid_inr": (kept_min + kept_max) / 2,
        "salary_disclosed": kept_min.isNotNull(), "salary_flag": flag,
        "usd_listed": F.col("_usd"), "usd_with_pay": F.col("_usd_paid"),
    }).drop("_lo", "_hi", "_usd", "_usd_paid", "_a", "_b", "_min", "_max", "_implausible")


def has_title(title: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", "nan")


def tidy(raw: DataFrame) -> DataFrame:
    """Trimmed ids, titles and companies, parsed tags, one row per id, near-duplicate group."""
    named = raw.withColumns({
        "jobId": F.trim(F.col("jobId").cast("string")), "title": F.trim("title"),
        "companyName": F.trim(F.coalesce("companyName", F.lit(""))),
    })
    kept = drop_repeated_ids(named).withColumn("tags", tx.split_tags(F.col("tagsAndSkills")))
    return kept.withColumn(
        "dup_group_id", near_duplicate_group(F.col("companyName"), F.col("title"), F.col("tags"))
    )


def clean_postings(raw: DataFrame, usd_policy: str = "exclude", usd_rate: float | None = None) -> DataFrame:
    """The full chain: one shuffle for the id de-duplication, everything else per row."""
    titled = tidy(raw).filter(has_title(F.col("title")))
    uploaded = F.lower(F.trim("jobUploaded"))
    dated = titled.withColumns({
        "posted_date": num.posting_date(F.col("jobId")), "days_ago": num.days_ago(F.col("jobUploaded")),
        "future_start": F.coalesce(uploaded.startswith("starts"), F.lit(False)),
    })
    rating = F.col("AggregateRating").try_cast("double")
    return with_pay(with_experience(dated), usd_policy, usd_rate).withColumns({
        "company_rating": F.when(rating.between(0, 5), rating),
        "company_reviews": F.col("ReviewsCount").try_cast("double"),
        "n_tags": F.size("tags").cast("long"),
    })


def step_log(raw: DataFrame) -> DataFrame:
    """Rows left and removed per cleaning step, from one pass over the tidied rows and one count of the raw ones."""
    titled = has_title(F.col("title"))
    counts = tidy(raw).agg(
        F.count(F.lit(1)).alias("unique_ids"), F.countDistinct("dup_group_id").alias("groups"),
        F.count_if(titled).alias("titled"), F.count_if(titled & (F.size("tags") > 0)).alias("tagged"),
    ).withColumn("raw", raw.agg(F.count(F.lit(1))).scalar())
    none = F.lit(None).cast("long")

    def step(name: str, rows: str, removed: Column, groups: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), F.col(rows).alias("rows"), removed.alias("removed"), groups.alias("groups"))

    return counts.select(F.inline(F.array(
        step("raw", "raw", none, none),
        step("unique_ids", "unique_ids", F.col("raw") - F.col("unique_ids"), none),
        step("near_duplicate_groups", "unique_ids", none, F.col("groups")),
        step("titled", "titled", F.col("unique_ids") - F.col("titled"), none),
        step("tagged", "tagged", F.col("titled") - F.col("tagged"), none),
    )))


def missing_share(df: DataFrame, columns: Sequence[str], blank_is_missing: bool = True) -> DataFrame:
    """Share of missing values per column as (column, missing) rows, in one aggregate."""

    def missing(c: str) -> Column:
        absent = F.col(c).isNull()
        if blank_is_missing:
            absent = absent | (F.trim(F.col(c).cast("string")) == "")
        return F.avg(absent.cast("double")).alias(c)

    shares = df.agg(*[missing(c) for c in columns])
    return shares.unpivot([], list(columns), "column", "missing")


def scrape_evidence(raw: DataFrame) -> DataFrame:
    """Does posting date + age meet on one scrape date? One row: that date, agreement and coverage of the dates.

    The scrape date is the most frequent implied date, the earliest of equals.
    """
    dated = raw.select(
        num.posting_date(F.col("jobId")).alias("posted"), num.days_ago(F.col("jobUploaded")).alias("age")
    ).withColumn("implied", F.date_add("posted", F.col("age").cast("int")))
    votes = dated.filter(F.col("implied").isNotNull()).groupBy("implied").agg(F.count(F.lit(1)).alias("n"))
    mode = votes.agg(F.max_by("implied", F.struct("n", -F.unix_date("implied")))).scalar()
    near = F.abs(F.datediff("implied", "scrape")) <= 1
    recent = F.datediff("scrape", "posted") <= 14
    return dated.withColumn("scrape", mode).agg(
        F.date_format(F.max("scrape"), "yyyy-MM-dd").alias("scrape_date"),
        F.count("implied").alias("rows_with_age"),
        F.round(F.avg(F.when(F.col("implied").isNotNull(), near.cast("double"))), 4).alias("share_within_1_day"),
        F.round(F.avg(F.col("posted").isNotNull().cast("double")), 4).alias("id_parse_rate"),
        F.date_format(F.min("posted"), "yyyy-MM-dd").alias("first_posted"),
        F.date_format(F.max("posted"), "yyyy-MM-dd").alias("last_posted"),
        F.round(F.avg(F.when(F.col("posted").isNotNull(), recent.cast("double"))), 4).alias("share_within_14_days"),
    )


def recent_weekdays(raw: DataFrame, scrape_date: str, days: int = 30) -> DataFrame:
    """Postings per weekday over the last `days` before the scrape date."""
    posted = num.posting_date(F.col("jobId"))
    return (
        raw.select(posted.alias("posted"))
        .filter(F.datediff(F.lit(scrape_date).cast("date"), "posted") <= days)
        .groupBy(F.date_format("posted", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("postings"))
    )


def pay_audit(cleaned: DataFrame, by: str | None = None) -> DataFrame:
    """Dollar, swapped, implausible and disclosed counts, overall or per value of `by` (null kept as 'unknown')."""
    keys = [] if by is None else [F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)]
    return cleaned.groupBy(*keys).agg(
        F.count_if("usd_listed").alias("usd_rows"), F.count_if("usd_with_pay").alias("usd_rows_with_pay"),
        F.count_if("pay_swapped").alias("swapped"),
        F.count_if(F.col("salary_flag") == "implausible").alias("implausible"),
        F.count_if("salary_disclosed").alias("disclosed"),
        F.round(F.avg(F.col("salary_disclosed").cast("double")), 4).alias("disclosed_share"),
    )
