"""Exact de-duplication by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes. Each round splits the open groups by their next digit: one aggregation counts the
(group, digit) classes, with map-side combining, and one join hands the counts back. A document leaves as soon as its
class holds it alone or the class has ended (its digit is shorter than the round's width), so every byte is moved once
for documents with copies and only the first digit decides for most others. No digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.session import cut

SPACES = " \t\n\x0b\f\r"
FIRST_DIGIT = 256
GROWTH = 4


def without_spaces(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    return F.translate(text, SPACES, "")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Texts are equal when their bytes without ASCII white space are; a null text counts as an empty one, and all empty
    texts are one group. The row with the longest original text stays, then the smallest id; a null id comes last. Rows
    that repeat one id and one text are alike and get the same values. An empty table gives an empty result; other
    columns of `docs`, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = without_spaces(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.sha2(body, 256).alias("text_sha256"),
        F.lit(None).cast(f"struct<id:{dict(docs.dtypes)[id_col]},sha:string>").alias("part"), F.encode(body, "UTF-8").alias("rest"))
    width, done = first_digit, None
    while True:
        placed = cut(_split(rows, width))
        ended = placed.filter("rest is null").select("doc_id", "keep_id", "keep_chars", "chars", "group_size", "text_sha256")
        done = ended if done is None else done.unionByName(ended)
        rows = placed.filter("rest is not null").select("doc_id", "chars", "text_sha256", "part", "rest")
        if rows.isEmpty():
            break
        width *= growth
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return done.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Rows with the size, name and kept row of their class; `rest` is null where the class is final."""
    cutoff = F.substring("rest", 1, width)
    digits = rows.withColumn("digit", cutoff)
    best = F.max_by(F.struct(F.col("doc_id").alias("id"), F.col("chars").alias("chars")), F.struct("chars", (-F.col("doc_id")).alias("low")))
    classes = (
        digits.groupBy(F.col("part").alias("in_part"), F.col("digit").alias("in_digit"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))).alias("name"),
             best.alias("best"))
        .filter("n > 1"))
    same = F.col("part").eqNullSafe(F.col("in_part")) & (F.col("digit") == F.col("in_digit"))
    open_ = F.col("n").isNotNull() & (F.length("digit") == width)
    return digits.join(classes, same, "left").select(
        "doc_id", "chars", "text_sha256",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("best.chars", "chars").alias("keep_chars"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(open_, F.col("name")).alias("part"),
        F.when(open_, F.expr(f"substring(rest, {width + 1}, length(rest))")).alias("rest"))
