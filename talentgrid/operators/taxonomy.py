"""Node and edge tables of the skills taxonomy and of the postings, and questions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.functions.distributed import best_per_group, item_pairs, item_sets, listed_once, pick_one
from talentgrid.session import cut

# Thematic collections and the flag each one sets on a skill.
COLLECTION_FLAGS = {
    "digital_skills": "is_digital",
    "green_skills": "is_green",
    "digcomp_skills": "is_digcomp",
    "research_skills": "is_research",
    "transversal_skills": "is_transversal",
    "language_skills": "is_language",
}


def _uris(df: DataFrame, column: str = "conceptUri") -> DataFrame:
    return df.select(F.trim(column).alias("uri")).filter(F.length("uri") > 0).distinct()


def _concepts(df: DataFrame, **columns: str) -> DataFrame:
    """One row per concept, the last listed values winning."""
    named = df.select(F.trim("conceptUri").alias("uri"), *[F.col(c).alias(name) for name, c in columns.items()])
    return listed_once(named.filter(F.length("uri") > 0), ["uri"], last=True)


def _links(df: DataFrame, src: str, dst: str, *extra: Column) -> DataFrame:
    rows = df.select(F.trim(src).alias("src"), F.trim(dst).alias("dst"), *extra)
    return rows.filter((F.length("src") > 0) & (F.length("dst") > 0))


def taxonomy_nodes(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    occupations = catalog["occupations_core"].unionByName(catalog["occupations_research"], allowMissingColumns=True)
    skills = _concepts(
        catalog["skills_core"], label="preferredLabel", alternates="altLabels", description="description",
        skill_type="skillType", reuse_level="reuseLevel", status="status").withColumn("alternates", tx.split_lines(F.col("alternates")))
    for dataset, flag in COLLECTION_FLAGS.items():
        members = _uris(catalog[dataset]).withColumn(flag, F.lit(True))
        skills = skills.join(members, "uri", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    levels = catalog["skills_hierarchy"].select(F.explode(F.array(*[
        F.struct(F.trim(f"Level {i} URI").alias("uri"), F.col(f"Level {i} preferred term").alias("label")) for i in range(4)
    ])).alias("g")).select("g.*").filter(F.length("uri") > 0)
    groups = _concepts(catalog["skill_groups"], label="preferredLabel").unionByName(listed_once(levels, ["uri"]).join(
        _uris(catalog["skill_groups"]), "uri", "left_anti"))
    schemes = catalog["concept_schemes"].select(F.trim("conceptSchemeUri").alias("uri"), F.col("preferredLabel").alias("label"))
    return {
        "Occupation": _concepts(
            occupations, label="preferredLabel", alternates="altLabels", description="description", isco_code="iscoGroup",
            status="status").withColumn("alternates", tx.split_lines(F.col("alternates"))),
        "Skill": skills,
        "SkillGroup": groups,
        "OccupationGroup": _concepts(catalog["isco_groups"], label="preferredLabel", code="code"),
        "ConceptScheme": listed_once(schemes.filter(F.length("uri") > 0), ["uri"]),
    }


def taxonomy_edges(catalog: dict[str, DataFrame], nodes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed edges between existing nodes. Which side is a skill, group or occupation decides the type of a broader link."""
    uri = {label: df.select("uri") for label, df in nodes.items()}

    def between(rows: DataFrame, src: str, dst: str) -> DataFrame:
        once = listed_once(rows, ["src", "dst"], last=True)
        return once.join(uri[src].withColumnRenamed("uri", "src"), "src", "left_semi").join(
            uri[dst].withColumnRenamed("uri", "dst"), "dst", "left_semi")

    requires = catalog["occupation_skill_relations"]
    skill_broader = _links(catalog["skills_broader_relations"], "conceptUri", "broaderUri")
    occ_broader = _links(catalog["occupation_broader_relations"], "conceptUri", "broaderUri")
    steps = [F.struct(F.trim(f"Level {i} URI").alias("src"), F.trim(f"Level {i - 1} URI").alias("dst")) for i in (3, 2, 1)]
    level_links = catalog["skills_hierarchy"].select(F.inline(F.array(*steps))).filter(
        (F.length("src") > 0) & (F.length("dst") > 0))
    occupations, skills = catalog["occupations_core"], catalog["skills_core"]
    by_code = occupations.select(F.trim("conceptUri").alias("src"), F.trim("iscoGroup").alias("code")).join(
        nodes["OccupationGroup"].select("code", F.col("uri").alias("dst")), "code").select("src", "dst")

    def schemes(df: DataFrame) -> DataFrame:
        return df.select(F.trim("conceptUri").alias("src"), F.explode(tx.words_of(F.coalesce("inScheme", F.lit("")))).alias("dst"))

    return {
        "REQUIRES": between(_links(requires, "occupationUri", "skillUri", F.col("relationType").alias("relation")), "Occupation", "Skill"),
        "RELATED_SKILL": between(_links(
            catalog["skill_skill_relations"], "originalSkillUri", "relatedSkillUri", F.col("relationType").alias("relation")), "Skill", "Skill"),
        "IN_SKILL_GROUP": between(skill_broader, "Skill", "SkillGroup"),
        "BROADER_THAN_SKILL_GROUP": between(skill_broader.unionByName(level_links), "SkillGroup", "SkillGroup"),
        "IN_OCC_GROUP": between(occ_broader.unionByName(by_code), "Occupation", "OccupationGroup"),
        "BROADER_OCCUPATION": between(occ_broader, "Occupation", "Occupation"),
        "BROADER_THAN_OCC_GROUP": between(occ_broader, "OccupationGroup", "OccupationGroup"),
        "IN_SCHEME": between(schemes(occupations), "Occupation", "ConceptScheme").unionByName(
            between(schemes(skills), "Skill", "ConceptScheme")),
    }


def posting_graph(jobs: DataFrame, job_city: DataFrame, job_tag: DataFrame, tag_link: DataFrame) -> tuple[dict, dict]:
    """Node and edge tables of postings.

    `jobs(job_id, company, exp_band, occupation, ...)`, `job_city(job_id, rank, city, state)`, `job_tag(job_id, tag)`,
    `tag_link(tag, uri, score, method, accepted)`.
    """
    companies = jobs.select("job_id", F.trim(F.lower("company")).alias("key"), "company").filter(F.length("key") > 0)
    cities = job_city.filter(F.col("city").isNotNull()).withColumn("key", F.concat_ws("|", "city", "state"))
    states = job_city.filter(F.col("state").isNotNull())
    same_as = tag_link.filter(F.col("accepted") & F.col("uri").isNotNull())
    nodes = {
        "Job": jobs,
        "Company": companies.groupBy("key").agg(F.min_by("company", "job_id").alias("name")),
        "City": cities.groupBy("key").agg(F.min("city").alias("city"), F.min("state").alias("state")),
        "State": states.select("state").distinct(),
        "ExperienceBand": jobs.filter(F.col("exp_band").isNotNull()).select("exp_band").distinct(),
        "Tag": listed_once(tag_link, ["tag"]),
    }
    edges = {
        "POSTS": companies.select(F.col("key").alias("src"), F.col("job_id").alias("dst")),
        "LOCATED_IN": cities.groupBy(F.col("job_id").alias("src"), F.col("key").alias("dst")).agg(F.min("rank").alias("rank")),
        "IN_STATE": nodes["City"].select(F.col("key").alias("src"), F.col("state").alias("dst")).unionByName(
            states.filter(F.col("city").isNull()).select(F.col("job_id").cast("string").alias("src"), F.col("state").alias("dst")).distinct()),
        "NEEDS_EXP": jobs.filter(F.col("exp_band").isNotNull()).select(F.col("job_id").alias("src"), F.col("exp_band").alias("dst")),
        "TAGGED": job_tag.select(F.col("job_id").alias("src"), F.col("tag").alias("dst")),
        "SAME_AS": same_as.select(F.col("tag").alias("src"), F.col("uri").alias("dst"), "score", "method"),
        "REQUIRES": job_tag.join(same_as, "tag").select(F.col("job_id").alias("src"), F.col("uri").alias("dst")).distinct(),
        "MAPS_TO": jobs.filter(F.col("occupation").isNotNull()).select(F.col("job_id").alias("src"), F.col("occupation").alias("dst")),
    }
    return nodes, edges


def size_table(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """Row count per node label and edge type."""
    out = None
    for kind, tables in (("node", nodes), ("edge", edges)):
        for name, df in tables.items():
            row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
            out = row if out is None else out.unionByName(row)
    return out


def ancestors(edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """(node, ancestor, hops) along (src, dst) edges, the shortest distance up to `max_hops`.

    Each hop extends only pairs found first in the last hop; the growing result is written out so plans stay short.
    """
    links = edges.select("src", "dst").distinct()
    found = cut(links.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("hops")))
    frontier = found
    for hop in range(2, max_hops + 1):
        longer = frontier.join(links, frontier.ancestor == links.src).select("node", F.col("dst").alias("ancestor")).distinct()
        frontier = cut(longer.join(found, ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def nearest_field(skills: DataFrame, broader: DataFrame, fields: DataFrame) -> DataFrame:
    """Field of each skill: the closest ancestor (or itself) in `fields(uri, field)`; the smaller name of equals.

    Hops go on until no skill has a new ancestor; ancestors seen before are not visited again, so cycles end. Unknown
    fields are dropped.
    """
    links = broader.select("src", "dst").distinct()
    frontier = cut(skills.select(F.col("uri").alias("skill_id"), F.col("uri").alias("node")).distinct())
    seen, done = frontier, None
    while not frontier.isEmpty():
        hits = cut(frontier.join(fields, frontier.node == fields.uri).groupBy("skill_id").agg(F.min("field").alias("field")))
        done = hits if done is None else done.unionByName(hits)
        open_rows = frontier.join(hits, "skill_id", "left_anti")
        further = open_rows.join(links, open_rows.node == links.src).select("skill_id", F.col("dst").alias("node")).distinct()
        frontier = cut(further.join(seen, ["skill_id", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    if done is None:
        done = skills.select(F.col("uri").alias("skill_id")).join(fields.select(F.col("uri").alias("skill_id"), "field"), "skill_id")
    return done.filter(F.col("field") != "field unknown")


def skill_gaps(
    wanted: DataFrame, requirements: DataFrame, owned: DataFrame, essential_only: bool = False, skill_type: str | None = None,
    membership: DataFrame | None = None, groups: list[str] | None = None,
) -> DataFrame:
    """Essential and optional skills of each wanted occupation, split into owned and missing, with the match percentage.

    `wanted(query_id, occupation, known)`: known false marks an occupation that does not exist and gets an error row; an
    existing one whose skills were all filtered away gets empty lists. `requirements(occupation, skill_id, relation,
    skill_type)`, `owned(query_id, skill_id)`, `membership(skill_id, grp)`.
    """
    kept = requirements
    if essential_only:
        kept = kept.filter(F.lower(F.coalesce("relation", F.lit(""))).contains("essential"))
    if skill_type:
        kept = kept.filter(F.col("skill_type") == skill_type)
    if groups:
        kept = kept.join(membership.filter(F.col("grp").isin(groups)), "skill_id", "left_semi")
    rows = wanted.join(kept, "occupation", "left").join(owned.withColumn("has", F.lit(True)), ["query_id", "skill_id"], "left")
    essential = F.lower(F.coalesce("relation", F.lit("optional"))).contains("essential")
    has = F.coalesce("has", F.lit(False))

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("skill_id"))))

    n, hit = F.count("skill_id"), F.count_if(has)
    return rows.groupBy("query_id", "occupation").agg(
        names(essential).alias("essential"), names(~essential).alias("optional"), names(has).alias("matched"),
        names(~has).alias("missing"), F.round(F.try_divide(100 * hit, n), 1).alias("match_pct"),
        F.when(F.max("known"), F.lit(None).cast("string")).otherwise("unknown occupation").alias("error"))


def occupations_in_groups(memberships: DataFrame, wanted_groups: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Occupations of each wanted group: its own, those of groups with a longer code, and of groups up to five hops below.

    `memberships(occupation, grp, code)`, `wanted_groups(filter_id, grp, code)`, `hierarchy(src, dst)`. Codes are matched
    on every prefix of the member code, an equi-join.
    """
    own = memberships.join(wanted_groups.select("filter_id", "grp"), "grp").select("filter_id", "occupation")
    prefixes = memberships.select("occupation", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("prefix"))
    by_code = prefixes.join(wanted_groups, prefixes.prefix == wanted_groups.code).select("filter_id", "occupation")
    below = ancestors(hierarchy)
    by_path = memberships.join(below, memberships.grp == below.node).select("occupation", "ancestor").join(
        wanted_groups.select("filter_id", F.col("grp").alias("ancestor")), "ancestor").select("filter_id", "occupation")
    return own.unionByName(by_code).unionByName(by_path).distinct()


def constellation(
    edges: DataFrame, n_skills: int = 140, n_edges: int = 360, min_together: int = 30
) -> DataFrame:
    """Strongest positive co-listing edges among the most demanded skills, scored ln(lift).

    The top-N cut comes before the pairs, so a posting only emits pairs of those skills.
    """
    demand = edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    top = demand.orderBy(F.desc("n"), "skill_id").limit(n_skills)
    sets = item_sets(edges.join(top, "skill_id", "left_semi"), "job_id", "skill_id")
    together = item_pairs(sets).groupBy("a", "b").agg(F.count(F.lit(1)).alias("postings")).filter(F.col("postings") >= min_together)
    total = edges.agg(F.countDistinct("job_id").alias("n")).scalar()
    scored = (
        together.join(top.select(F.col("skill_id").alias("a"), F.col("n").alias("na")), "a")
        .join(top.select(F.col("skill_id").alias("b"), F.col("n").alias("nb")), "b").withColumn("total", total)
        .withColumn("weight", F.log(F.col("postings") * F.col("total") / (F.col("na") * F.col("nb"))))
    )
    return scored.filter(F.col("weight") > 0).select("a", "b", "postings", "weight").orderBy(
        F.desc(F.round("weight", 9)), "a", "b").limit(n_edges)


def characteristic_skills(
    postings: DataFrame, edges: DataFrame, n_occupations: int = 30, k: int = 4, min_postings: int = 10
) -> DataFrame:
    """The k skills most over-represented in the postings of each of the largest occupations."""
    listed = postings.join(edges.select("job_id").distinct(), "job_id", "left_semi")
    top = listed.groupBy("occupation").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "occupation").limit(n_occupations)
    demand = edges.groupBy("skill_id").agg(F.count(F.lit(1)).alias("demand"))
    total = edges.agg(F.countDistinct("job_id").alias("n")).scalar()
    counts = listed.select("job_id", "occupation").join(edges, "job_id").groupBy("occupation", "skill_id").agg(
        F.count(F.lit(1)).alias("postings")).filter(F.col("postings") >= min_postings)
    scored = counts.join(top, "occupation").join(demand, "skill_id").withColumn("total", total).withColumn(
        "lift", (F.col("postings") / F.col("size")) / (F.col("demand") / F.col("total")))
    return best_per_group(scored, ["occupation"], [F.desc(F.round("lift", 9)), F.asc("skill_id")], k).select(
        "occupation", "skill_id", "postings", F.log("lift").alias("weight"))


def evidence_paths(job_skill: DataFrame, tagged: DataFrame, same_as: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tag → skill ← posting → occupation path of every (job_id, skill_id) edge; all parts but the edge are optional.

    The best-scored tag of a posting for the skill is shown.
    """
    tags = pick_one(
        tagged.join(same_as, "tag").select("job_id", F.col("uri").alias("skill_id"), "tag", "score", "method"),
        ["job_id", "skill_id"], [F.desc("score"), F.asc("tag")])
    return job_skill.join(tags, ["job_id", "skill_id"], "left").join(jobs, "job_id", "left")
