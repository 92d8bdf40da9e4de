"""Numeric, date and hashing expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Experience bands and their lower bounds in years.
EXPERIENCE_BANDS = ["0-1", "1-3", "3-6", "6-10", "10+"]

# Score bands of link quality samples.
SCORE_BANDS = ["exact", "0.80+", "0.70-0.80", "0.60-0.70", "<0.60"]


def days_ago(c: Column) -> Column:
    """Age in days of a relative upload text; null when it names no age."""
    t = F.lower(F.trim(c))
    fresh = t.isin("just now", "today", "few hours ago") | t.endswith("hours ago") | t.endswith("hour ago")
    number = F.regexp_extract(t, r"^(\d+)\+?\s*days?\s+ago$", 1)
    return F.when(fresh, 0.0).otherwise(number.try_cast("double"))


def posting_date(job_id: Column) -> Column:
    """Date held in the first six characters of an id as DDMMYY (69-99 are 19xx); null when they are no date."""
    head = F.substring(job_id.cast("string"), 1, 6)
    century = F.when(F.substring(head, 5, 2) >= "69", "19").otherwise("20")
    full = F.concat(F.substring(head, 1, 4), century, F.substring(head, 5, 2))
    return F.when(head.rlike(r"^\d{6}$"), F.try_to_timestamp(full, F.lit("ddMMyyyy"))).cast("date")


def experience_band(years: Column) -> Column:
    return (
        F.when(years.isNull(), F.lit(None).cast("string"))
        .when(years <= 1, "0-1")
        .when(years < 3, "1-3")
        .when(years < 6, "3-6")
        .when(years < 10, "6-10")
        .otherwise("10+")
    )


def score_band(method: Column, score: Column) -> Column:
    return (
        F.when(method == "exact", "exact")
        .when((score >= 0.8) & (score < 1.01), "0.80+")
        .when((score >= 0.7) & (score < 0.8), "0.70-0.80")
        .when((score >= 0.6) & (score < 0.7), "0.60-0.70")
        .otherwise("<0.60")
    )


def hash_bucket(key: Column, salt: str, buckets: int) -> Column:
    """Stable bucket of a key: the first 32 bits of its salted SHA-256, modulo `buckets`."""
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def hash_order(key: Column, salt: str) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def named_split(bucket: Column, limits: Sequence[tuple[str, int]]) -> Column:
    """Name of the first split whose upper limit exceeds the bucket; the last name takes the rest."""
    out = F.lit(limits[-1][0])
    for name, upper in reversed(limits[:-1]):
        out = F.when(bucket < upper, name).otherwise(out)
    return out


# Upper bucket limits of the hash splits.
RANKING_SPLIT = [("train", 70), ("val", 80), ("test", 90), ("pool", 100)]
PAY_SPLIT = [("train", 70), ("cal", 85), ("test", 100)]
BAND_SPLIT = [("train", 6000), ("validation", 7500), ("calibration", 8500), ("test", 10000)]


def group_code(uri: Column) -> Column:
    """Last path segment of a group URI without its leading C."""
    tail = F.regexp_extract(F.regexp_replace(uri, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(tail, "^[cC]", "")


def occupation_family(code: Column) -> Column:
    """Four-digit family codes that do not start with 0; anything else is null."""
    trimmed = F.trim(code)
    return F.when(trimmed.rlike(r"^[1-9]\d{3}$"), trimmed)


def l2_to_cosine(squared_distance: Column) -> Column:
    return F.least(F.greatest(1 - squared_distance / 2, F.lit(0.0)), F.lit(1.0))


def wilson_interval(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson score interval clipped to [0, 1]; null for an empty sample."""
    z = F.lit(1.96)
    p = F.try_divide(successes.cast("double"), n)
    denominator = 1 + F.try_divide(z * z, n)
    centre = (p + F.try_divide(z * z, 2 * n)) / denominator
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z * z, 4 * n * n)) / denominator
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def round_thousands(c: Column) -> Column:
    """Nearest thousand, ties to the even thousand."""
    return F.bround(c, -3)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.isnan(c) | F.abs(c).isin(float("inf")), F.lit(None)).otherwise(c)


def support_key(code: Column, tier: Column) -> Column:
    return F.concat_ws("|", F.coalesce(code, F.lit("NA")), F.coalesce(tier.cast("int").cast("string"), F.lit("0")))


def native_pay(c: Column) -> Column:
    """Number in a pay text with an optional L suffix; null (a violation row) when it does not parse."""
    return F.trim(F.regexp_replace(c, "L", "")).try_cast("double")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
