"""Search and listing queries over concepts and postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(column: str, text: str | None) -> Column:
    """Case-insensitive literal substring; an empty search matches everything."""
    return F.lit(True) if not text else F.lower(F.col(column)).contains(text.lower())


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def _any_of(df: DataFrame, edges: DataFrame | None, wanted: Sequence[str] | None) -> DataFrame:
    if not wanted:
        return df
    chosen = edges.filter(F.col("dst").isin(list(wanted))).select(F.col("src").alias("uri"))
    return df.join(chosen, "uri", "left_semi")


def search_occupations(
    occupations: DataFrame, q: str | None = None, in_group: DataFrame | None = None, groups: Sequence[str] | None = None,
    requires: DataFrame | None = None, skills: Sequence[str] | None = None, in_scheme: DataFrame | None = None,
    schemes: Sequence[str] | None = None, offset: int = 0, limit: int = 20,
) -> DataFrame:
    """Occupations whose label contains q and that meet any of each given filter list, by lower-cased label."""
    rows = occupations.filter(contains("label", q))
    for edges, wanted in ((in_group, groups), (requires, skills), (in_scheme, schemes)):
        rows = _any_of(rows, edges, wanted)
    return page(rows, [F.lower("label"), F.col("uri")], offset, limit)


def search_skills(
    skills: DataFrame, q: str | None = None, skill_type: str | None = None, in_group: DataFrame | None = None,
    groups: Sequence[str] | None = None, in_scheme: DataFrame | None = None, schemes: Sequence[str] | None = None,
    related: DataFrame | None = None, related_to: str | None = None, offset: int = 0, limit: int = 20,
) -> DataFrame:
    """Skills by label, type, groups and schemes, or those related to one skill in either direction."""
    rows = skills.filter(contains("label", q))
    if skill_type:
        rows = rows.filter(F.col("skill_type") == skill_type)
    if related_to:
        near = related.filter(F.col("src") == related_to).select(F.col("dst").alias("uri")).unionByName(
            related.filter(F.col("dst") == related_to).select(F.col("src").alias("uri")))
        rows = rows.join(near, "uri", "left_semi")
    for edges, wanted in ((in_group, groups), (in_scheme, schemes)):
        rows = _any_of(rows, edges, wanted)
    return page(rows, [F.lower("label"), F.col("uri")], offset, limit)


def autocomplete(concepts: DataFrame, q: str | None, limit: int, fold_case: bool = False) -> DataFrame:
    """Labelled concepts containing q, by label."""
    rows = concepts.filter(F.col("label").isNotNull() & contains("label", q))
    return rows.orderBy(F.lower("label") if fold_case else F.col("label"), "uri").limit(limit)


def search_postings(
    postings: DataFrame, q: str | None, tier: int | None, state: str | None, offset: int, limit: int
) -> DataFrame:
    """One page of matching postings by id, each row carrying the total number of matches."""
    rows = postings.filter(contains("title", q))
    if tier is not None:
        rows = rows.filter(F.col("tier") == tier)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(rows, [F.col("job_id")], offset, limit).withColumn("total", total)


def schemes_in_use(schemes: DataFrame, in_scheme: DataFrame) -> DataFrame:
    """Concept schemes with at least one member, and how many."""
    members = in_scheme.groupBy(F.col("dst").alias("uri")).agg(F.count(F.lit(1)).alias("members"))
    return schemes.join(members, "uri").orderBy(F.lower("label"), "uri")


def market_pool(
    postings: DataFrame, occupation: str | None = None, isco2: str | None = None, exp_bands: Sequence[str] | None = None,
    tiers: Sequence[int] | None = None, states: Sequence[str] | None = None, exclude_group: str | None = None,
    occupations: Sequence[str] | None = None, fields: DataFrame | None = None, field: str | None = None,
) -> DataFrame:
    """Postings meeting every given filter; an occupation overrides the group prefix; a field filters through
    `fields(job_id, field)`."""
    rows = postings
    if occupation:
        rows = rows.filter(F.col("occupation") == occupation)
    elif isco2:
        rows = rows.filter(F.col("isco2") == isco2)
    for column, wanted in (("exp_band", exp_bands), ("tier", tiers), ("state", states), ("occupation", occupations)):
        if wanted:
            rows = rows.filter(F.col(column).isin(list(wanted)))
    if exclude_group:
        rows = rows.filter(F.col("dup_group_id") != exclude_group)
    if field:
        rows = rows.join(fields.filter(F.col("field") == field), "job_id", "left_semi")
    return rows


def frequent_terms(rows: DataFrame, owner: str, term: str, min_count: int = 3) -> DataFrame:
    """Distinct (owner, term) rows whose term has at least `min_count` owners; owners left empty disappear."""
    kept = rows.select(owner, term).distinct()
    common = kept.groupBy(term).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return kept.join(common, term, "left_semi")
