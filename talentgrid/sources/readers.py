"""Readers of taxonomy, reference and gazetteer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talentgrid.functions.distributed import listed_once

# Dataset names of the taxonomy folder and the files that hold them.
CATALOG_FILES = {
    "occupations_core": "occupations_en.csv",
    "occupations_research": "researchOccupationsCollection_en.csv",
    "skills_core": "skills_en.csv",
    "occupation_skill_relations": "occupationSkillRelations_en.csv",
    "skill_skill_relations": "skillSkillRelations_en.csv",
    "skills_hierarchy": "skillsHierarchy_en.csv",
    "skills_broader_relations": "broaderRelationsSkillPillar_en.csv",
    "skill_groups": "skillGroups_en.csv",
    "isco_groups": "ISCOGroups_en.csv",
    "occupation_broader_relations": "broaderRelationsOccPillar_en.csv",
    "concept_schemes": "conceptSchemes_en.csv",
    "digital_skills": "digitalSkillsCollection_en.csv",
    "green_skills": "greenSkillsCollection_en.csv",
    "digcomp_skills": "digCompSkillsCollection_en.csv",
    "research_skills": "researchSkillsCollection_en.csv",
    "transversal_skills": "transversalSkillsCollection_en.csv",
    "language_skills": "languageSkillsCollection_en.csv",
}

# Columns of the place file, in file order.
PLACE_COLUMNS = [
    "gid", "name", "ascii", "alternates", "lat", "lon", "fclass", "fcode", "cc", "cc2", "admin1", "admin2", "admin3", "admin4",
    "population", "elev", "dem", "tz", "modified",
]


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted multi-line cells, every column text, `,` or `;` by its first line, empty cells as ''.

    Multi-line files cannot be split; convert a large one to parquet once.
    """
    header = spark.read.option("wholetext", False).text(path).first()
    line = header[0] if header else ""
    delimiter = ";" if line.count(";") > line.count(",") else ","
    df = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def load_catalog(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named taxonomy datasets, all 17 by default; of repeated skill concepts the first stays."""
    out = {name: read_catalog_csv(spark, f"{folder}/{CATALOG_FILES[name]}") for name in names or CATALOG_FILES}
    if "skills_core" in out:
        out["skills_core"] = listed_once(out["skills_core"], ["conceptUri"])
    return out


def read_reference_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Small CSV whose leading `#` lines are comments; later cells and lines may contain `#`.

    `columns` names the cells in file order; the header line is recognised by them and dropped.
    """
    whole = spark.read.text(path, wholetext=True)
    body = whole.select(F.regexp_replace("value", "^﻿?(?:#[^\\n]*\\n)*", "").alias("text")).select(
        F.explode(F.filter(F.split("text", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)).alias("line"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = body.select(F.from_csv("line", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return parsed.na.fill("").filter(F.col(columns[0]) != columns[0])


def read_places(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """Populated places of the unquoted, header-less place file with their state; `states(code, state)`."""
    schema = StructType([StructField(c, StringType()) for c in PLACE_COLUMNS])
    raw = spark.read.csv(path, sep="\t", quote="", schema=schema)
    kept = raw.filter("fclass = 'P'").select(
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ascii", F.lit("")).alias("ascii"),
        F.coalesce("alternates", F.lit("")).alias("alternates"), "admin1",
        F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"),
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))
    return kept.join(states.withColumnRenamed("code", "admin1"), "admin1").drop("admin1")


def file_stamps(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Path, size and change time of the files behind an input, with a content hash on request.

    Without `content` only file metadata is read; hash contents of small reference files only.
    """
    files = spark.read.format("binaryFile").load(path)
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    return files.select("path", "length", F.col("modificationTime").cast("string").alias("changed"), digest.alias("sha256"))


def source_version(stamps: DataFrame) -> DataFrame:
    """One row `version`: the root of a tree of digests over the files of an input, whatever order they are listed in.

    Files go to 65,536 leaves by the hash of their path, leaves to 256 branches, and branches to the root, so no row holds
    more than a small part of the stamps.
    """
    mark = F.concat_ws("|", "path", "length", F.coalesce("sha256", "changed"))
    together = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "\n"), 256).alias("digest")
    files = stamps.select(F.substring(F.sha2("path", 256), 1, 4).alias("leaf"), F.sha2(mark, 256).alias("digest"))
    leaves = files.groupBy("leaf").agg(together)
    branches = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(together)
    return branches.agg(together).select(F.col("digest").alias("version"))


def cached_parquet(spark: SparkSession, source: DataFrame, stamps: DataFrame, folder: str) -> DataFrame:
    """Parquet copy of a slow source under the version of its files; written only when that version is missing.

    A version counts once it is whole, which its success marker says, so a run that was broken off leaves nothing to read.
    Copies of other versions are deleted then: readers always find exactly the version of the source as it is.
    """
    version = source_version(stamps).first()["version"][:16]
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    target = f"{folder}/v={version}"
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
        source.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(target)
    for old in files.listStatus(root):
        if old.getPath().getName().startswith("v=") and old.getPath().getName() != f"v={version}":
            files.delete(old.getPath(), True)
    return spark.read.parquet(target)


def recorded_versions(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(name, version) of every named input path, to be written beside what was made from them."""
    rows = None
    for name, path in sources.items():
        row = source_version(file_stamps(spark, path)).select(F.lit(name).alias("name"), "version")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def staleness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Inputs with the version recorded for them and the one they have: (name, status).

    `outdated` where they differ, `gone` where the input is no longer there, `unrecorded` where it was never used.
    """
    both = recorded.select("name", F.col("version").alias("was")).join(current.select("name", F.col("version").alias("now_")), "name", "full")
    status = F.when(F.col("was").isNull(), "unrecorded").when(F.col("now_").isNull(), "gone").when(
        F.col("was") == F.col("now_"), "current").otherwise("outdated")
    return both.select("name", status.alias("status"))
