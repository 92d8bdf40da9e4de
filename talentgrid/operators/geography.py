"""Resolution of location strings to cities, states and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.functions.distributed import listed_once, pick_one
from talentgrid.session import cut

# Planning regions of the large metros.
METRO_REGIONS = {
    "Delhi NCR": ["Delhi", "Gurugram", "Noida", "Greater Noida", "Ghaziabad", "Faridabad", "Sonipat", "Manesar"],
    "Mumbai MMR": [
        "Mumbai", "Thane", "Navi Mumbai", "Kalyan-Dombivli", "Vasai-Virar", "Bhiwandi", "Mira-Bhayandar", "Panvel",
    ],
    "Pune": ["Pune", "Pimpri-Chinchwad"],
    "Bengaluru": ["Bengaluru"],
    "Hyderabad": ["Hyderabad"],
    "Chennai": ["Chennai"],
    "Kolkata": ["Kolkata", "Howrah"],
    "Ahmedabad": ["Ahmedabad", "Gandhinagar"],
}

# Places outside the country.
FOREIGN_WORDS = [
    "united arab emirates", "uae", "dubai", "abu dhabi", "sharjah", "saudi arabia", "riyadh", "jeddah", "qatar", "doha",
    "oman", "muscat", "kuwait", "bahrain", "singapore", "malaysia", "usa", "united states", "united states of america",
    "uk", "united kingdom", "london", "canada", "australia", "germany", "japan", "nepal", "sri lanka", "bangladesh",
    "philippines", "indonesia", "africa",
]

# State and district spellings with the state they stand for.
STATE_SPELLINGS = {
    "dadra nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "dadra and nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "daman diu": "Dadra and Nagar Haveli and Daman and Diu",
    "daman and diu": "Dadra and Nagar Haveli and Daman and Diu",
    "silvassa": "Dadra and Nagar Haveli and Daman and Diu",
    "north goa": "Goa",
    "south goa": "Goa",
    "gautam buddha nagar": "Uttar Pradesh",
    "orissa": "Odisha",
    "pondicherry": "Puducherry",
    "j k": "Jammu and Kashmir",
    "jammu kashmir": "Jammu and Kashmir",
    "andaman nicobar": "Andaman and Nicobar",
}

ALTERNATE_MIN_POPULATION = 50_000
FUZZY_MIN_POPULATION = 20_000
FUZZY_RATIO = 0.92


def metro_region(city: Column) -> Column:
    region = F.lit(None).cast("string")
    for name, members in METRO_REGIONS.items():
        region = F.when(city.isin(members), name).otherwise(region)
    return region


def gazetteer(places: DataFrame) -> DataFrame:
    """One row per place key from (name, ascii, alternates, state, population, lat, lon); the most populous wins.

    Alternate ASCII names count only for larger places.
    """
    big = F.col("population") >= ALTERNATE_MIN_POPULATION
    alternates = F.filter(
        F.split(F.coalesce("alternates", F.lit("")), ","), lambda a: (F.length(a) > 0) & ~a.rlike(r"[^\x00-\x7F]")
    )
    names = F.concat(F.array("name", "ascii"), F.when(big, alternates).otherwise(F.array().cast("array<string>")))
    keyed = places.filter(F.col("state").isNotNull()).select(
        F.explode(F.array_distinct(F.transform(names, tx.place_norm))).alias("key"),
        F.when(F.length("ascii") > 0, F.col("ascii")).otherwise(F.col("name")).alias("place"),
        "state", "population", "lat", "lon",
    ).filter(F.length("key") > 0)
    return pick_one(keyed, ["key"], [F.desc("population"), F.asc("place"), F.asc("state")])


def _segment(key_length: Column, index: Column, parts: Column) -> tuple[Column, Column]:
    """Start (1-based) and length of segment `index` when a key of that length is cut into `parts` even pieces."""
    start = F.floor(key_length * index / parts)
    end = F.floor(key_length * (index + 1) / parts)
    return (start + 1).cast("int"), (end - start).cast("int")


def _allowed_edits(key_length: Column) -> Column:
    """Most insertions and deletions a key of this length can take and still reach the ratio."""
    return F.floor(key_length * (2 * (1 - FUZZY_RATIO) / FUZZY_RATIO) + 1e-9).cast("int")


def fuzzy_matches(keys: DataFrame, places: DataFrame, min_population: int = FUZZY_MIN_POPULATION) -> DataFrame:
    """Best place key per key with 2·LCS/(len+len) of at least 92 %; the larger place wins between equal ratios.

    Place keys are cut into one segment more than the edits they may take, so every true match shares an unchanged
    segment within that many positions: an equi-join on (length, segment number, text) finds all of them.
    """
    index = (
        places.filter(F.col("population") >= min_population)
        .select(F.col("key").alias("place_key"), "population", F.length("key").alias("len"))
        .withColumn("edits", _allowed_edits(F.col("len")))
        .withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("len"), F.col("seg"), F.col("edits") + 1)
    index = index.select("place_key", "population", "len", "seg", F.substring("place_key", start, size).alias("piece"))

    n = F.length("key")
    shortest, longest = F.ceil(n * (FUZZY_RATIO / (2 - FUZZY_RATIO))), F.floor(n * ((2 - FUZZY_RATIO) / FUZZY_RATIO))
    probes = (
        keys.select("key").distinct().filter(n > 0)
        .withColumn("len", F.explode(F.sequence(F.greatest(shortest, F.lit(1)).cast("int"), longest.cast("int"))))
        .withColumn("edits", _allowed_edits(F.col("len")))
        .withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("len"), F.col("seg"), F.col("edits") + 1)
    probes = (
        probes.withColumns({"start": start, "size": size})
        .withColumn("shift", F.explode(F.sequence(-F.col("edits"), F.col("edits"))))
        .withColumn("at", F.col("start") + F.col("shift"))
        .filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= n))
        .select("key", "len", "seg", F.substring("key", F.col("at"), F.col("size")).alias("piece"))
    )
    total = F.length("key") + F.length("place_key")
    near = F.levenshtein("key", "place_key") <= F.floor((1 - FUZZY_RATIO) * total + 1e-9)
    scored = (
        probes.join(index, ["len", "seg", "piece"]).select("key", "place_key", "population").distinct().filter(near)
        .withColumn("ratio", 2.0 * tx.common_length(F.col("place_key"), F.col("key")) / total)
        .filter(F.col("ratio") >= FUZZY_RATIO)
    )
    best = pick_one(scored, ["key"], [F.desc("ratio"), F.desc("population"), F.asc("place_key")])
    return best.select("key", "place_key")


def alias_names(aliases: DataFrame) -> DataFrame:
    """(key, alias_city, lookup_key, city_key) of every alias; of several rows for one alias the last listed counts."""
    return listed_once(aliases.select(
        tx.place_norm(F.col("alias")).alias("key"), F.trim("city").alias("alias_city"),
        tx.place_norm(F.when(F.length("lookup") > 0, F.col("lookup")).otherwise(F.col("city"))).alias("lookup_key"),
        tx.place_norm(F.col("city")).alias("city_key"),
    ), ["key"], last=True)


def with_canonical_name(rows: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the usual name of the city in `column`: that of its alias in `names` (of `alias_names`), else its own, trimmed."""
    renamed = names.select(F.col("key").alias("_name_key"), F.col("alias_city").alias("_renamed"))
    return rows.withColumn("_name_key", tx.place_norm(F.col(column))).join(renamed, "_name_key", "left").withColumn(
        name, F.coalesce("_renamed", F.trim(column))).drop("_name_key", "_renamed")


def with_canonical_state(rows: DataFrame, column: str = "state", aliases: DataFrame | None = None) -> DataFrame:
    """Rows with the usual name of the state in `column`; `aliases(spelling, name)` adds spellings of its own, known in any case."""
    named = rows.withColumn(column, tx.canonical_state(F.col(column)))
    if aliases is None:
        return named
    own = listed_once(aliases.select(F.lower(tx.canonical_state(F.col("spelling"))).alias("_spelling"), F.col("name").alias("_name")), ["_spelling"], last=True)
    return named.withColumn("_spelling", F.lower(column)).join(own, "_spelling", "left").withColumn(
        column, F.coalesce("_name", column)).drop("_spelling", "_name")


def resolve_tokens(tokens: DataFrame, places: DataFrame, aliases: DataFrame, states: DataFrame) -> DataFrame:
    """City, state and match method of every distinct token.

    `tokens(token)`, `places` from `gazetteer`, `aliases(alias, city, lookup)`, `states(state)`. Precedence: foreign,
    alias, exact, state, fuzzy; unmatched tokens keep a null method. What is looked up first is written once, so that the
    fuzzy branch only sees the keys that are still open.
    """
    alias_rows = cut(alias_names(aliases))
    places = cut(places)
    spark = tokens.sparkSession
    spellings = spark.createDataFrame(list(STATE_SPELLINGS.items()), "spelling string, state string")
    named = states.select(tx.place_norm(F.col("state")).alias("key"), F.col("state").alias("named_state"))
    state_rows = listed_once(named.unionByName(spellings.select(F.col("spelling").alias("key"), F.col("state").alias("named_state"))), ["key"])

    def place(prefix: str) -> DataFrame:
        return places.select(
            F.col("key").alias(f"{prefix}_key"),
            F.struct("place", "state", "population", "lat", "lon").alias(f"{prefix}_hit"))

    keyed = tokens.select("token").distinct().withColumn(
        "key", tx.place_norm(F.regexp_replace("token", "&", " "))).filter(F.length("key") > 0)
    joined = cut(
        keyed.join(alias_rows, "key", "left")
        .withColumn("exact_key", F.when(F.col("alias_city").isNull(), F.col("key")).otherwise(F.col("lookup_key")))
        .join(place("exact"), "exact_key", "left").join(place("city"), "city_key", "left")
        .join(state_rows, "key", "left")
        .withColumn("hit", F.coalesce("exact_hit", "city_hit"))
        .withColumn("foreign", F.col("key").isin(FOREIGN_WORDS))
    )
    open_keys = joined.filter(F.col("hit").isNull() & F.col("named_state").isNull() & ~F.col("foreign"))
    fuzzy = fuzzy_matches(open_keys, places).join(place("place"), "place_key").select("key", "place_hit")
    found = joined.join(fuzzy, "key", "left").withColumn(
        "method",
        F.when(F.col("foreign"), "foreign").when(F.col("hit").isNotNull() & F.col("alias_city").isNotNull(), "alias")
        .when(F.col("hit").isNotNull(), "exact").when(F.col("named_state").isNotNull(), "state_only")
        .when(F.col("place_hit").isNotNull(), "fuzzy"),
    ).withColumn("hit", F.when(~F.col("foreign"), F.coalesce("hit", "place_hit")))
    is_city = F.col("method").isin("alias", "exact", "fuzzy")
    named = with_canonical_name(found.withColumn("_place", F.when(is_city, F.col("hit.place"))), alias_rows, "_place", "_usual")
    return named.select(
        "token", F.col("method").alias("matched_by"),
        F.when(is_city, F.coalesce("alias_city", "_usual")).alias("city"),
        F.when(is_city, F.col("hit.state")).when(F.col("method") == "state_only", F.col("named_state")).alias("state"),
        *[F.when(is_city, F.col(f"hit.{c}")).alias(c) for c in ("population", "lat", "lon")])


def with_tier(cities: DataFrame, tiers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Tier of each (city, state) from `tiers(city, tier, tier_state)`; 3 unless listed for that state.

    Of several rows for one city the last listed counts, so a place never becomes two rows. With `aliases` both the listed
    and the asked city are first brought to their usual names.
    """
    listed, asked = tiers.withColumn("_at", F.monotonically_increasing_id()), cities.withColumn("_usual", F.col("city"))
    if aliases is not None:
        names = alias_names(aliases)
        listed, asked = with_canonical_name(listed, names, "city", "city"), with_canonical_name(asked, names, "city", "_usual")
    once = listed.groupBy(F.col("city").alias("_usual")).agg(F.max_by(F.struct("tier", "tier_state"), "_at").alias("_t")).select("_usual", "_t.*")
    joined = asked.join(once, "_usual", "left").drop("_usual")
    other_state = (F.length("tier_state") > 0) & F.col("state").isNotNull() & (F.col("tier_state") != F.col("state"))
    tier = F.when(F.col("city").isNull(), F.lit(None).cast("int")).when(
        F.col("tier").isNull() | F.coalesce(other_state, F.lit(False)), 3).otherwise(F.col("tier"))
    return joined.withColumn("tier", tier.cast("int")).drop("tier_state")


def job_places(jobs: DataFrame, places: DataFrame, aliases: DataFrame, states: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row per resolved place of each job, foreign ones included; `jobs(job_id, location)`.

    Tokens are resolved once per distinct text and joined back.
    """
    tokens = jobs.select(
        "job_id", F.posexplode(tx.location_tokens(tx.location_parts(F.col("location")))).alias("rank", "token"))
    resolved = resolve_tokens(tokens, places, aliases, states).filter(F.col("matched_by").isNotNull())
    found = tokens.join(resolved, "token")
    kept = pick_one(
        found.withColumns({c: F.coalesce(F.col(s), F.lit("")) for c, s in (("_c", "city"), ("_s", "state"))}),
        ["job_id", "_c", "_s", "matched_by"], [F.asc("rank")],
    ).drop("_c", "_s", "token")
    return with_tier(kept, tiers, aliases).withColumn("metro_region", metro_region(F.col("city")))


def geocode(jobs: DataFrame, job_city: DataFrame) -> DataFrame:
    """Jobs with work mode, primary place and place counts; a city is primary before a bare state, then listed order."""
    home = job_city.filter(F.col("matched_by") != "foreign")
    order = F.struct(F.col("city").isNull(), F.col("rank"))
    summary = job_city.groupBy("job_id").agg(
        F.max((F.col("matched_by") == "foreign").cast("int")).alias("_foreign"))
    primary = home.groupBy("job_id").agg(
        F.min_by(F.struct("city", "state", "tier", "metro_region"), order).alias("p"),
        F.count("city").alias("n_cities"), F.count(F.lit(1)).alias("n_places"),
    )
    return (
        jobs.withColumn("work_mode", tx.work_mode(tx.location_parts(F.col("location"))))
        .join(primary, "job_id", "left").join(summary, "job_id", "left")
        .select(
            *jobs.columns, "work_mode", (F.coalesce("_foreign", F.lit(0)) == 1).alias("has_foreign_location"),
            *[F.col(f"p.{c}").alias(f"primary_{c}") for c in ("city", "state", "tier", "metro_region")],
            F.coalesce("n_cities", F.lit(0)).alias("n_cities"), F.coalesce("n_places", F.lit(0)).alias("n_places"),
        )
    )


def place_audit(geocoded: DataFrame) -> DataFrame:
    """Resolution counts of geocoded jobs, one row."""
    placed, remote = F.col("n_places") > 0, F.col("work_mode") == "remote"
    foreign, city = F.col("has_foreign_location"), F.col("primary_city").isNotNull()
    return geocoded.agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(placed).alias("resolved_place"), F.count_if(city).alias("resolved_city"),
        F.count_if(placed & ~city).alias("state_only"), F.count_if(foreign & ~placed).alias("foreign_only"),
        F.count_if(remote & ~placed).alias("remote_only"), F.count_if(~placed & ~remote & ~foreign).alias("unresolved"),
        F.round(F.count_if(placed) / F.greatest(F.count_if(placed | ~remote), F.lit(1)), 4).alias("rate_excl_remote"),
        F.count_if(F.col("n_cities") > 1).alias("multi_city"),
    )
