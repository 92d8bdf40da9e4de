"""Linking of tags and titles to concepts: exact labels, then vector candidates, thresholds and skill-aware re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.functions.distributed import best_per_group, listed_once, pick_one
from talentgrid.functions.vectors import nearest


def concept_labels(concepts: DataFrame) -> DataFrame:
    """(uri, preferred, label, kind, priority) rows of `concepts(uri, preferred, alternates)`."""
    return concepts.select("uri", "preferred", F.inline(tx.label_variants(F.col("preferred"), F.col("alternates"))))


def exact_dictionary(labels: DataFrame, key: Callable[[Column], Column] = tx.normalize_tag) -> DataFrame:
    """The concept of each label key at its best label kind; keys shared by several concepts there are left out."""
    keyed = labels.withColumn("key", key(F.col("label"))).filter(F.length("key") > 0)
    per_kind = keyed.groupBy("key", "priority").agg(
        F.min("uri").alias("uri"), (F.min("uri") == F.max("uri")).alias("single"))
    best = per_kind.groupBy("key").agg(F.min_by(F.struct("uri", "single"), "priority").alias("b"))
    return best.filter("b.single").select("key", F.col("b.uri").alias("uri"))


def exact_links(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """`texts(text)` with the uri of an exact, unambiguous label match or null."""
    keyed = texts.withColumn("key", tx.normalize_tag(F.col("text")))
    return keyed.join(exact_dictionary(labels), "key", "left").drop("key")


def vector_candidates(queries: DataFrame, label_vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k best concepts per query by their best label: (query_id, uri, score, rank).

    `label_vectors(uri, vector)`; a concept scores as its best label does.
    """
    return nearest(queries, label_vectors.select("uri", "vector"), k, item="uri")


def link(
    texts: DataFrame, labels: DataFrame, label_vectors: DataFrame, threshold: float, single_word: float | None = None, k: int = 5
) -> DataFrame:
    """Best concept per text: (text, uri, score, method, accepted, candidates).

    `texts(text, vector)` must be distinct. An exact match scores 1 and heads the candidate list; otherwise the best
    vector candidate counts, accepted from `threshold` (one-word texts from `single_word` when that is higher).
    """
    exact = exact_links(texts.select("text"), labels).withColumnRenamed("uri", "exact_uri")
    queries = texts.select(F.col("text").alias("query_id"), "vector")
    found = vector_candidates(queries, label_vectors, k).groupBy(F.col("query_id").alias("text")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "uri", F.round("score", 4).alias("score")))),
                    lambda c: F.struct(c["uri"].alias("uri"), c["score"].alias("score"))).alias("found"))
    names = listed_once(labels.filter("priority = 0").select("uri", F.col("label")), ["uri"])
    head = F.struct(F.col("exact_uri").alias("uri"), F.lit(1.0).alias("score"))
    none = F.array().cast("array<struct<uri:string,score:double>>")
    listed = exact.join(found, "text", "left").withColumn("found", F.coalesce("found", none)).withColumn(
        "candidates",
        F.when(F.col("exact_uri").isNull(), F.col("found")).otherwise(F.slice(F.concat(
            F.array(head), F.filter("found", lambda c: c["uri"] != F.col("exact_uri"))), 1, k)))
    one_word = F.size(tx.words_of(F.col("text"))) == 1
    need = F.lit(threshold) if single_word is None else F.when(one_word, max(threshold, single_word)).otherwise(threshold)
    method = F.when(F.col("exact_uri").isNotNull(), "exact").when(F.size("candidates") > 0, "embedding").otherwise("none")
    best = listed.withColumns({
        "uri": F.get("candidates", F.lit(0))["uri"], "score": F.coalesce(F.get("candidates", F.lit(0))["score"], F.lit(0.0)),
        "method": method})
    accepted = F.col("uri").isNotNull() & ((F.col("method") == "exact") | (F.col("score") >= need))
    return best.join(names, "uri", "left").select("text", "uri", "label", "score", "method", accepted.alias("accepted"), "candidates")


def rerank_titles(
    candidates: DataFrame, job_skills: DataFrame, requirements: DataFrame, alpha: float, margin: float = 0.08
) -> DataFrame:
    """Occupation of each job among near-equal title candidates, helped by the job's skills.

    `candidates(job_id, pos, occupation, score)`, `job_skills(job_id, skill_id)`, `requirements(occupation, skill_id,
    relation)`. Only candidates within `margin` of the best compete; an exact title or a job without skills keeps the first.
    """
    sizes = job_skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_skills"))
    top = candidates.groupBy("job_id").agg(F.min_by("score", "pos").alias("top"))
    weight = F.when(F.col("relation") == "essential", 1.0).otherwise(0.5)
    shared = (
        candidates.select("job_id", "occupation").join(job_skills, "job_id")
        .join(requirements, ["occupation", "skill_id"]).groupBy("job_id", "occupation").agg(F.sum(weight).alias("hit"))
    )
    rows = candidates.join(top, "job_id").join(sizes, "job_id", "left").join(shared, ["job_id", "occupation"], "left").withColumn(
        "overlap", F.coalesce(F.col("hit") / F.col("n_skills"), F.lit(0.0)))
    fixed = (F.col("top") >= 1.0) | F.col("n_skills").isNull()
    combined = F.when(fixed, F.col("score")).otherwise(alpha * F.col("score") + (1 - alpha) * F.col("overlap"))
    open_rows = rows.withColumn("combined", combined).filter(
        F.when(fixed, F.col("pos") == 0).otherwise(F.col("score") >= F.col("top") - margin))
    best = pick_one(open_rows, ["job_id"], [F.desc(F.round("combined", 9)), F.asc("pos")])
    return best.select("job_id", "occupation", F.col("score").alias("title_sim"), "overlap", "combined")


def link_coverage(links: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Share of unique texts and of mentions linked at each threshold; exact links always count.

    `links(freq, method, score)`.
    """
    exploded = links.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    hit = (F.col("method") == "exact") | (F.col("score") >= F.col("threshold"))
    return exploded.groupBy("threshold").agg(
        F.avg(hit.cast("double")).alias("unique_share"),
        (F.sum(F.when(hit, F.col("freq")).otherwise(0)) / F.sum("freq")).alias("mention_share"))


def method_counts(links: DataFrame, threshold: float) -> DataFrame:
    """Texts and mentions per link method, and how many one-word links the single-word guard refused.

    `links(tag, freq, method, score, accepted)`.
    """
    refused = ~F.col("accepted") & (F.col("score") >= threshold) & (F.size(tx.words_of(F.col("tag"))) == 1)
    return links.groupBy("method").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("freq").alias("mentions"), F.count_if("accepted").alias("accepted"),
        F.count_if(refused).alias("guard_refused"))


def job_skills_from_tags(job_tags: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct posting-skill edges of accepted tag links; several tags may name one skill."""
    return job_tags.join(links.filter("accepted").select("tag", "uri"), "tag").select("job_id", F.col("uri").alias("skill_id")).distinct()


def extraction_dictionary(labels: DataFrame, links: DataFrame, min_freq: int = 5) -> DataFrame:
    """Label key → uri for text extraction: labels by kind, then frequent accepted tags that are no labels."""
    keyed = labels.withColumn("key", tx.dictionary_key(F.col("label"))).filter(F.length("key") > 0)
    named = keyed.groupBy("key").agg(F.min_by("uri", F.struct("priority", "uri")).alias("uri"))
    tags = links.filter(F.col("accepted") & (F.col("freq") >= min_freq)).withColumn("key", tx.dictionary_key(F.col("tag")))
    extra = tags.filter(F.length("key") > 0).groupBy("key").agg(F.min_by("uri", F.struct(-F.col("freq"), "uri")).alias("uri"))
    return named.unionByName(extra.join(named, "key", "left_anti"))


def concept_texts(concepts: DataFrame, relations: DataFrame, skills: DataFrame) -> DataFrame:
    """Lower-cased search text per occupation: label. description. skill names in relation order.

    `concepts(uri, label, description)`, `relations(uri, pos, skill_uri)`, `skills(skill_uri, name)`.
    """
    named = relations.join(skills, "skill_uri", "left").groupBy("uri").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), " ").alias("names"))
    return concepts.join(named, "uri", "left").select(
        "uri", F.lower(F.concat_ws(". ", F.coalesce("label", F.lit("")), F.coalesce("description", F.lit("")),
                                   F.coalesce("names", F.lit("")))).alias("text"))


def hashed_vectors(texts: DataFrame, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """`texts(text)` with unit vectors from the given encoder, by default hashed character trigrams."""
    return texts.withColumn("vector", (encoder or tx.trigram_vector)(F.col("text")))
