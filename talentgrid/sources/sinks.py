"""Writers of table sets, graphs, reports and review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.distributed import listed_once
from talentgrid.functions.numeric import finite
from talentgrid.sources.readers import source_version


def write_tables(tables: dict[str, DataFrame], folder: str, long_text: dict[str, tuple[str, list[str]]] | None = None) -> None:
    """Parquet per table; wide text columns move to a table of their own, keyed by the given id.

    `long_text` maps a table to (key, columns).
    """
    for name, df in tables.items():
        key, wide = (long_text or {}).get(name, ("", []))
        df.drop(*wide).write.mode("overwrite").parquet(f"{folder}/{name}")
        if wide:
            df.select(key, *wide).write.mode("overwrite").parquet(f"{folder}/{name}_text")


def write_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], folder: str, node_keys: dict[str, str]) -> None:
    """Node and edge tables, one folder per label and type; a repeated load replaces them and gives the same rows.

    Of repeated nodes and edges the last listed stays; the first two columns of an edge table are its ends.
    """
    for label, df in nodes.items():
        listed_once(df, [node_keys.get(label, "uri")], last=True).write.mode("overwrite").parquet(f"{folder}/nodes_{label}")
    for kind, df in edges.items():
        listed_once(df, df.columns[:2], last=True).write.mode("overwrite").parquet(f"{folder}/edges_{kind}")


def report_rows(report: str, section: str, metrics: DataFrame) -> DataFrame:
    """A one-row metrics table as (report, section, metric, value) with non-finite numbers nulled."""
    numeric = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal(38,0)")]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), finite(F.col(c).cast("double")).alias("value")) for c in numeric])
    return metrics.select(F.inline(cells)).select(F.lit(report).alias("report"), F.lit(section).alias("section"), "metric", "value")


def with_provenance(rows: DataFrame, stamps: DataFrame, script: str, seed: int) -> DataFrame:
    """Report rows with the fingerprint of their inputs, script, seed and UTC time."""
    inputs = source_version(stamps).scalar()
    return rows.withColumns({"inputs": inputs, "script": F.lit(script), "seed": F.lit(seed), "generated_at": F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def write_report(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def finite_numbers(df: DataFrame) -> DataFrame:
    """Every floating column with NaN and infinities as null."""
    def clean(name: str, kind: str) -> Column:
        return finite(F.col(name)).alias(name) if kind in ("double", "float") else F.col(name)

    return df.select(*[clean(f.name, f.dataType.typeName()) for f in df.schema.fields])


def write_field_snapshots(df: DataFrame, field: str, folder: str) -> None:
    """JSON lines per field value; numbers that JSON cannot hold are null."""
    finite_numbers(df).write.mode("overwrite").partitionBy(field).json(folder)


def write_partition_manifest(prepared: DataFrame, folder: str) -> None:
    prepared.select("row_key", "group_id", "split").write.mode("overwrite").option("header", True).csv(folder)


def merge_review_sample(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Reviewed rows stay as they are; only unseen keys are added."""
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def review_status(sample: DataFrame, current: DataFrame, key: str, reviewed: str) -> DataFrame:
    """complete when every sampled row that still exists has a review, else pending; one row."""
    rows = sample.join(current.select(key), key, "left_semi")
    done = F.bool_and(F.length(F.trim(F.coalesce(reviewed, F.lit("")))) > 0)
    return rows.agg(F.when((F.count(F.lit(1)) > 0) & done, "complete").otherwise("pending").alias("status"), F.count(F.lit(1)).alias("rows"))


def append_labels(labels: DataFrame, sample: DataFrame, key: str, folder: str) -> None:
    """Append labels whose key is in the frozen sample."""
    labels.join(sample.select(key), key, "left_semi").write.mode("append").parquet(folder)


def unknown_label_keys(labels: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return labels.join(sample.select(key), key, "left_anti")
