"""Ordinal pay bands: preparation, fit metrics, calibration, audits, rules and cohort statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions import numeric as num
from talentgrid.functions import text as tx
from talentgrid.functions.distributed import average_ranks, exact_quantiles, item_pairs, order_statistic
from talentgrid.operators.grouping import connected_groups
from talentgrid.session import cut

# Pay bands in order and the years that split experience slices.
BANDS = ["0to3", "3to6", "6to10", "10to15", "15to25", "25to50"]
TOP_BAND = len(BANDS) - 1
EXPERIENCE_PATTERN = r"^\s*(\d+)\s*-\s*(\d+)\s*yrs?\s*$"


def experience_range(cell: Column) -> tuple[Column, Column]:
    """Lower and upper years of an 'a - b yrs' cell; null when it does not parse."""
    return F.regexp_extract(cell, EXPERIENCE_PATTERN, 1).try_cast("double"), F.regexp_extract(cell, EXPERIENCE_PATTERN, 2).try_cast("double")


def collapse_copies(raw: DataFrame, id_column: str) -> DataFrame:
    """One row per distinct content (nulls equal) with its multiplicity; copies merge map-side."""
    return raw.groupBy(*[c for c in raw.columns if c != id_column]).agg(F.count(F.lit(1)).alias("multiplicity"))


def input_violations(raw: DataFrame, id_column: str) -> DataFrame:
    """Rows that preparation would refuse: (id, problem)."""
    low, high = experience_range(F.col("experience"))
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("salary").isin(BANDS), F.lit(False)), "unknown pay band"),
        F.when(low.isNull() | high.isNull(), "unparsed experience"), F.when(low > high, "reversed experience")))
    return raw.select(F.col(id_column).alias("id"), F.explode(problems).alias("problem"))


def shape_bands(raw: DataFrame, id_column: str = "s_no") -> DataFrame:
    """Distinct postings with band, skills, experience, flags and signatures, not yet grouped.

    `raw` carries the id, job_desig, key_skills, location, experience, salary and job_description as text. Rows named by
    `input_violations` must be repaired first; they are left out here.
    """
    rows = collapse_copies(raw, id_column)
    content = [c for c in rows.columns if c != "multiplicity"]
    low, high = experience_range(F.col("experience"))
    skills = tx.skill_list(F.col("key_skills"))
    cell = F.coalesce("key_skills", F.lit(""))
    words = F.concat_ws(" ", F.lower(cell), F.lower(F.coalesce("job_desig", F.lit(""))))
    out = rows.withColumns({
        "row_key": F.concat(F.lit("analytics:"), F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in content])), 256), 1, 24)),
        "band": (F.array_position(F.array(*[F.lit(x) for x in BANDS]), F.col("salary")) - 1).cast("int"),
        "exp_min": low, "exp_max": high, "skills": skills, "skills_permissive": tx.skill_list(F.col("key_skills"), conservative=False),
        "skills_truncated": cell.endswith("..."), "description_missing": F.col("job_description").isNull(),
        "description_truncated": F.coalesce(F.col("job_description").endswith("..."), F.lit(False)),
        "role_family": tx.role_family(F.col("job_desig")), "quality_flag": tx.quality_flag(words),
        "locations": F.array_sort(F.array_distinct(F.filter(F.split(tx.normal(F.col("location")), "[,;/]"), lambda p: F.length(p) > 0))),
    }).filter(F.col("band").between(0, TOP_BAND) & (F.col("exp_min") <= F.col("exp_max")))
    joined = [tx.normal(F.col(c)) for c in ("job_desig", "key_skills", "location", "experience")]
    title = F.regexp_replace(tx.normal(F.col("job_desig")), "[^a-z0-9 ]", "")
    return out.withColumns({
        "exp_mid": (F.col("exp_min") + F.col("exp_max")) / 2, "exp_width": F.col("exp_max") - F.col("exp_min"),
        "feature_signature": F.sha2(F.concat_ws("|", *joined), 256),
        "near_signature": F.sha2(F.concat_ws("|", title, F.array_join("skills", "|"), tx.normal(F.col("location"))), 256),
    })


def with_groups(shaped: DataFrame) -> DataFrame:
    """`shape_bands` rows with their leak-free group and its split."""
    # Grouping reads the rows twice: once for the key graph, once to attach the group.
    grouped = connected_groups(cut(shaped), "row_key", [["feature_signature"], ["near_signature"]])
    bucket = num.hash_bucket(F.col("group_id"), "bands:", 10000)
    return grouped.withColumn("split", num.named_split(bucket, num.BAND_SPLIT))


def prepare_bands(raw: DataFrame, id_column: str = "s_no") -> DataFrame:
    """Distinct postings with band, skills, experience, flags, signatures, leak-free group and split."""
    return with_groups(shape_bands(raw, id_column))


def label_conflicts(prepared: DataFrame) -> DataFrame:
    """Feature groups with several bands, their rows, and the best agreement any function of the features could reach."""
    cells = prepared.groupBy("feature_signature", "band").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("feature_signature").agg(
        F.count(F.lit(1)).alias("bands"), F.sum("n").alias("rows"), F.max("n").alias("top"))
    return groups.agg(
        F.count_if(F.col("bands") > 1).alias("conflicting_groups"),
        F.sum(F.when(F.col("bands") > 1, F.col("rows")).otherwise(0)).alias("rows_in_conflict"),
        (F.sum("top") / F.sum("rows")).alias("agreement_bound"))


def soft_targets(prepared: DataFrame) -> DataFrame:
    """Share of each band per feature signature, one column per band."""
    shares = [(F.count_if(F.col("band") == i) / F.count(F.lit(1))).alias(f"share_{i}") for i in range(len(BANDS))]
    return prepared.groupBy("feature_signature").agg(F.count(F.lit(1)).alias("n"), *shares)


def confusion(scored: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Dense (band, prediction) counts per key."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = scored.groupBy(*keys, "band", "prediction").agg(amount.alias("n"))
    levels = F.sequence(F.lit(0), F.lit(TOP_BAND))
    # The grid comes from the counted cells, 36 rows per key.
    frame = cells.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else cells.agg(F.sum("n").alias("total"))
    grid = frame.withColumn("band", F.explode(levels)).withColumn("prediction", F.explode(levels))
    return grid.join(cells, [*keys, "band", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def band_metrics(scored: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Quadratic weighted kappa, macro F1, balanced accuracy, mean band error and share within one band, per key."""
    cells = confusion(scored, keys, weight)
    row = F.sum("n").over(Window.partitionBy(*keys, "band"))
    col = F.sum("n").over(Window.partitionBy(*keys, "prediction"))
    distance = F.abs(F.col("band") - F.col("prediction"))
    rich = cells.withColumns({"rows": row, "cols": col, "d": distance}).withColumn(
        "chance", F.col("rows") * F.col("cols") / F.col("total"))
    diagonal = F.col("band") == F.col("prediction")
    present = F.col("rows") > 0
    f1 = F.coalesce(F.try_divide(2 * F.col("n"), F.col("rows") + F.col("cols")), F.lit(0.0))
    return rich.groupBy(*keys).agg(
        F.max("total").alias("n"),
        (1 - F.try_divide(F.sum(F.col("d") * F.col("d") * F.col("n")), F.sum(F.col("d") * F.col("d") * F.col("chance")))).alias("qwk"),
        F.avg(F.when(diagonal, f1)).alias("macro_f1"),
        F.avg(F.when(diagonal & present, F.col("n") / F.col("rows"))).alias("balanced_accuracy"),
        (F.sum(F.col("d") * F.col("n")) / F.max("total")).alias("mean_band_error"),
        (F.sum(F.when(F.col("d") <= 1, F.col("n")).otherwise(0)) / F.max("total")).alias("within_one_band"),
        (F.sum(F.when(diagonal, F.col("n")).otherwise(0)) / F.max("total")).alias("accuracy"))


def calibration_radius(calibration: DataFrame, coverage: float = 0.9) -> DataFrame:
    """Half-width of band sets with the finite-sample target coverage, one row."""
    errors = calibration.select(F.abs(F.col("band") - F.col("prediction")).alias("e"))
    found = order_statistic(errors, [], "e", F.ceil((F.col("total") + 1) * coverage) - 1, "radius")
    return found.select(F.coalesce("radius", F.lit(TOP_BAND)).cast("int").alias("radius"), "n_values")


def with_band_sets(scored: DataFrame, radius: Column) -> DataFrame:
    return scored.withColumn("_r", radius).withColumns({
        "set_low": F.greatest(F.lit(0), F.col("prediction") - F.col("_r")),
        "set_high": F.least(F.lit(TOP_BAND), F.col("prediction") + F.col("_r")),
    }).withColumns({
        "covered": (F.col("band") >= F.col("set_low")) & (F.col("band") <= F.col("set_high")),
        "width": F.col("set_high") - F.col("set_low") + 1}).drop("_r")


def experience_slice(mid: Column) -> Column:
    return F.when(mid <= 2, "up to 2").when(mid <= 5, "above 2 to 5").when(mid <= 8, "above 5 to 8").otherwise("above 8")


def calibration_audit(covered: DataFrame, slices: dict[str, Column], min_rows: int = 30, min_groups: int = 20, replicates: int = 0) -> DataFrame:
    """Coverage and width of band sets per slice value; slices with little support keep their counts only.

    With replicates, a group-resampled interval of the coverage is added.
    """
    from talentgrid.operators.sampling import bootstrap_ratio

    parts = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))]
    parts += [F.struct(F.lit(name).alias("slice"), c.cast("string").alias("value")) for name, c in slices.items()]
    long = covered.select("group_id", F.col("covered").cast("long").alias("c"), "width", F.inline(F.array(*parts)))
    groups = long.groupBy("slice", "value", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("width").alias("w"))
    table = groups.groupBy("slice", "value").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), (F.sum("c") / F.sum("n")).alias("coverage"),
        (F.sum("w") / F.sum("n")).alias("mean_width"))
    supported = (F.col("rows") >= min_rows) & (F.col("groups") >= min_groups)
    out = table.withColumn("supported", supported).withColumns({
        c: F.when(F.col("supported"), F.col(c)) for c in ("coverage", "mean_width")})
    if replicates:
        ci = bootstrap_ratio(groups, "group_id", "c", "n", ["slice", "value"], replicates)
        out = out.join(ci, ["slice", "value"], "left").withColumns({c: F.when(F.col("supported"), F.col(c)) for c in ("low", "high")})
    return out


def validate_one_to_one(left: DataFrame, right: DataFrame, key: str, equal: Sequence[str], domains: dict[str, Sequence[int]]) -> DataFrame:
    """Violations of a one-to-one join: (key, problem) for repeated or unmatched keys, unequal columns, values out of range."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_na"), *[F.min(c).alias(f"_a_{c}") for c in equal])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"), *[F.min(c).alias(f"_b_{c}") for c in equal],
                               *[F.min(c).alias(f"_lo_{c}") for c in domains], *[F.max(c).alias(f"_hi_{c}") for c in domains])
    both = a.join(b, key, "full")
    checks = [F.when(F.col("_nb").isNull(), "missing on the right"), F.when(F.col("_na").isNull(), "missing on the left"),
              F.when(F.col("_na") > 1, "repeated on the left"), F.when(F.col("_nb") > 1, "repeated on the right")]
    matched = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    checks += [F.when(matched & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), f"different {c}") for c in equal]
    checks += [F.when((F.col(f"_lo_{c}") < min(v)) | (F.col(f"_hi_{c}") > max(v)), f"{c} out of range") for c, v in domains.items()]
    return both.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def association_rules(prepared: DataFrame, family: str = "role_family", min_count: int = 20, min_share: float = 0.01, top: int = 80) -> DataFrame:
    """Pair rules per family by lift.

    A pair cannot be more frequent than its skills, so only frequent skills enter the pairs; their number per family is
    bounded by the average list length over `min_share`.
    """
    lists = prepared.select(family, "row_key", F.col("skills").alias("items"))
    sizes = lists.groupBy(family).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "need", F.greatest(F.lit(min_count), F.floor(F.col("n") * min_share)))
    singles = lists.select(family, F.explode("items").alias("skill")).groupBy(family, "skill").agg(
        F.count(F.lit(1)).alias("c")).join(sizes, family).filter(F.col("c") >= F.col("need"))
    kept = lists.select(family, "row_key", F.explode("items").alias("skill")).join(
        singles.select(family, "skill"), [family, "skill"], "left_semi").groupBy(family, "row_key").agg(
        F.array_sort(F.collect_set("skill")).alias("items"))
    pairs = item_pairs(kept, [family]).groupBy(family, "a", "b").agg(F.count(F.lit(1)).alias("count"))
    one = singles.select(family, F.col("skill").alias("a"), F.col("c").alias("ca"), "n", "need")
    two = singles.select(family, F.col("skill").alias("b"), F.col("c").alias("cb"))
    frequent = pairs.join(one, [family, "a"]).join(two, [family, "b"]).filter(F.col("count") >= F.col("need"))
    sides = F.array(
        F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), F.col("ca").alias("base")),
        F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), F.col("cb").alias("base")))
    lift = F.col("count") * F.col("n") / (F.col("ca") * F.col("cb"))
    return frequent.withColumn("lift", lift).select(family, "count", "n", "lift", F.inline(sides)).select(
        F.col(family).alias("family"), "antecedent", "consequent", "count", (F.col("count") / F.col("n")).alias("support"),
        (F.col("count") / F.col("base")).alias("confidence"), "lift").orderBy(
        F.desc(F.round("lift", 9)), F.desc("count"), "family", "antecedent", "consequent").limit(top)


def step_up_adjusted(tests: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """False-discovery adjusted p values: the reverse running minimum of p·m/rank, at most 1, over a table of tests."""
    everyone = Window.partitionBy(*keys)
    m = F.count(F.lit(1)).over(everyone)
    ranked = tests.withColumns({"_rank": F.row_number().over(everyone.orderBy(p)), "_m": m})
    upward = everyone.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward))).drop("_rank", "_m")


def point_biserial(cohort: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with a 0/1 target: (feature, r, n)."""
    row = cohort.agg(F.count(F.lit(1)).alias("n"), *[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return row.unpivot(["n"], list(features), "feature", "r")


def cohort_models(cohort: DataFrame, features: Sequence[str], target: str, fold: Column, folds: int = 5, kind: str = "logistic") -> DataFrame:
    """Out-of-fold score of a logistic model or a depth-2 tree; groups must share a fold."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = cohort.withColumns({"_fold": fold, "_label": F.col(target).cast("double")})
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw")
    if kind == "tree":
        stages = [assemble, DecisionTreeClassifier(featuresCol="_raw", labelCol="_label", maxDepth=2, minInstancesPerNode=10)]
    else:
        stages = [assemble, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
                  LogisticRegression(featuresCol="_x", labelCol="_label", regParam=0.001, maxIter=50)]
    out = None
    for f in range(folds):
        model = Pipeline(stages=stages).fit(rows.filter(F.col("_fold") != f))
        scored = model.transform(rows.filter(F.col("_fold") == f)).select(*cohort.columns, vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def odds_ratios(cohort: DataFrame, features: Sequence[str], target: str) -> list[tuple[str, float]]:
    """Native-unit odds ratios of a lightly penalised logistic fit, one per feature."""
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(cohort.withColumn("_label", F.col(target).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_label", regParam=0.001, maxIter=100).fit(rows)
    return [(f, math.exp(c)) for f, c in zip(features, model.coefficients)]


def threshold_slopes(prepared: DataFrame, features: Sequence[str]) -> DataFrame:
    """Slopes of separate logits for band > t, t = 0..4, with group-clustered standard errors: (threshold, feature, slope, se).

    Each threshold is one distributed fit; the covariance is the inverse Hessian around the summed outer products of
    per-group score vectors, so only small matrices reach the driver.
    """
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = ["intercept", *features]
    base = VectorAssembler(inputCols=list(features), outputCol="_x").transform(prepared)
    results = []
    for t in range(TOP_BAND):
        rows = base.withColumn("_label", (F.col("band") > t).cast("double"))
        model = LogisticRegression(featuresCol="_x", labelCol="_label", regParam=0.0, maxIter=100).fit(rows)
        beta = [model.intercept, *model.coefficients]
        x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
        eta = sum((F.lit(float(c)) * v for c, v in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        k = len(names)
        hessian = rows.agg(*[F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(k)]).first()
        scores = rows.groupBy("group_id").agg(*[F.sum((F.col("_label") - p) * x[i]).alias(f"s{i}") for i in range(k)])
        meat = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        h = np.linalg.pinv(np.array(hessian, dtype=float).reshape(k, k))
        cov = h @ np.array(meat, dtype=float).reshape(k, k) @ h
        results += [(t, names[i], float(beta[i]), float(np.sqrt(max(cov[i, i], 0.0)))) for i in range(k)]
    return prepared.sparkSession.createDataFrame(results, "threshold int, feature string, slope double, se double")


def stacked_logits(rows: DataFrame, features: Sequence[str], thresholds: int = TOP_BAND, band: str = "band", group: str = "group_id", rounds: int = 50):
    """Separate logits for band > t, t = 0 .. thresholds - 1, fitted together: coefficients (t, feature), their covariance, converged.

    The equations of all thresholds are stacked and solved by Newton steps; a step is one pass, of which only sums per
    threshold and pair of features reach the driver. The covariance over all thresholds at once is the sandwich clustered by
    group, with the usual correction for few groups and rows, so it holds what one group adds to several thresholds.
    """
    import numpy as np

    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, converged = np.zeros((thresholds, k)), False

    def residual(t: int) -> tuple[Column, Column]:
        eta = sum((F.lit(float(c)) * v for c, v in zip(beta[t], x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        return p, (F.col(band) > t).cast("double") - p

    def inverse_hessian(sums, t: int):
        full = np.zeros((k, k))
        for i, j in pairs:
            full[i, j] = full[j, i] = sums[f"h{t}_{i}_{j}"] or 0.0
        return np.linalg.pinv(full)

    for _ in range(rounds):
        parts = []
        for t in range(thresholds):
            p, rest = residual(t)
            parts += [F.sum(rest * x[i]).alias(f"g{t}_{i}") for i in range(k)] + [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{t}_{i}_{j}") for i, j in pairs]
        sums = rows.agg(*parts).first()
        if sums["g0_0"] is None:
            break
        steps = np.array([inverse_hessian(sums, t) @ np.array([sums[f"g{t}_{i}"] for i in range(k)]) for t in range(thresholds)])
        beta = beta + steps
        if not np.isfinite(beta).all():
            break
        if np.abs(steps).max() <= 1e-10 * (1 + np.abs(beta).max()):
            converged = True
            break
    if not converged:
        return beta, np.full((thresholds * k, thresholds * k), np.nan), False
    scores = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(residual(t)[1] * x[i]).alias(f"s{t * k + i}") for t in range(thresholds) for i in range(k)])
    size = thresholds * k
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    meat = scores.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in upper]).first()
    middle, bread = np.zeros((size, size)), np.zeros((size, size))
    for i, j in upper:
        middle[i, j] = middle[j, i] = meat[f"m{i}_{j}"]
    for t in range(thresholds):
        bread[t * k : t * k + k, t * k : t * k + k] = inverse_hessian(sums, t)
    n = meat["rows"] * thresholds
    correction = meat["groups"] / max(meat["groups"] - 1, 1) * (n - 1) / max(n - size, 1)
    return beta, correction * bread @ middle @ bread, True


def chi_squared_tail(x: float, df: int) -> float:
    """Chance that a chi-squared number of `df` degrees of freedom exceeds x."""
    import math

    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    return total + math.exp(-half) * sum(half ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2))


def slope_contrasts(rows: DataFrame, features: Sequence[str], thresholds: int = TOP_BAND, group: str = "group_id") -> DataFrame:
    """Wald tests that a feature's slope is the same at all thresholds: (feature, statistic, df, p_value, p_fdr, status).

    Every slope is set against the one at the first threshold. The row of feature `(all)` tests all contrasts together and
    says whether equal slopes are rejected at 5 %; status is `inconclusive`, and numbers are null, where the fit does not
    converge or the contrasts' covariance has not full rank. p_fdr adjusts features for their number.
    """
    import numpy as np

    schema = "feature string, statistic double, df int, p_value double, p_fdr double, status string"
    beta, covariance, converged = stacked_logits(rows, features, thresholds, group=group)
    k = len(features) + 1
    contrasts = np.zeros((len(features) * (thresholds - 1), thresholds * k))
    for f in range(len(features)):
        for t in range(1, thresholds):
            contrasts[f * (thresholds - 1) + t - 1, [t * k + f + 1, f + 1]] = 1, -1
    spread = contrasts @ covariance @ contrasts.T
    if not converged or not np.isfinite(spread).all() or np.linalg.matrix_rank(spread) < len(contrasts):
        return rows.sparkSession.createDataFrame([(f, None, None, None, None, "inconclusive") for f in ("(all)", *features)], schema)

    def test(which: slice) -> tuple[float, int, float]:
        values = (contrasts @ beta.ravel())[which]
        statistic = float(values @ np.linalg.solve(spread[which, which], values))
        return statistic, len(values), chi_squared_tail(statistic, len(values))

    each = [test(slice(f * (thresholds - 1), (f + 1) * (thresholds - 1))) for f in range(len(features))]
    order = sorted(range(len(features)), key=lambda f: each[f][2])
    adjusted, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        least = min(least, each[order[rank - 1]][2] * len(order) / rank)
        adjusted[order[rank - 1]] = least
    whole = test(slice(None))
    said = lambda p: "rejected" if p < 0.05 else "not_rejected"
    table = [("(all)", *whole, None, said(whole[2]))] + [(f, *each[i], float(adjusted[i]), said(adjusted[i])) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(table, schema)


def band_classifier(prepared: DataFrame, skills: str = "skills", features: int = 12_000):
    """Fitted multinomial model on title, skill and location words and pairs plus numbers; predicts band 0..5."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, SQLTransformer, StandardScaler, VectorAssembler

    text = f"lower(concat_ws(' ', job_desig, array_join({skills}, ' '), location))"
    numbers = ["exp_min", "exp_max", "exp_width", "_truncated", "_no_description"]
    stages = [
        SQLTransformer(statement=f"""
            SELECT *, concat(_w, transform(slice(_w, 2, greatest(size(_w) - 1, 0)), (x, i) -> concat(_w[i], ' ', x))) AS _terms FROM (
              SELECT *, regexp_extract_all({text}, '([a-z0-9#+]{{2,}})', 1) AS _w, double(skills_truncated) AS _truncated,
                double(description_missing) AS _no_description FROM __THIS__)"""),
        CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=3.0, vocabSize=features), IDF(inputCol="_tf", outputCol="_tfidf"),
        VectorAssembler(inputCols=numbers, outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_ns", withMean=True),
        VectorAssembler(inputCols=["_tfidf", "_ns"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="band", predictionCol="_p", maxIter=20, regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(prepared)


def predict_bands(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(*rows.columns, F.col("_p").cast("int").alias("prediction"))


def majority_band(train: DataFrame) -> DataFrame:
    """Most frequent band, the lowest of equals, one row."""
    counts = train.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("band", F.struct("n", -F.col("band"))).alias("band"))


def champion(metrics: DataFrame, gain: float = 0.005) -> DataFrame:
    """Best model by kappa that beats the baseline model by more than `gain`; `metrics(model, qwk, baseline)`."""
    base = metrics.filter("baseline").agg(F.max("qwk").alias("q")).scalar()
    fit = metrics.filter(F.col("baseline") | (F.col("qwk") > base + gain))
    return fit.orderBy(F.desc("qwk"), F.desc("baseline"), "model").limit(1).select("model", "qwk")


def paired_errors(a: DataFrame, b: DataFrame, replicates: int = 200) -> DataFrame:
    """Mean change in absolute band error between two predictions of the same rows, with a group-resampled interval."""
    from talentgrid.operators.sampling import bootstrap_ratio

    rows = a.select("row_key", "group_id", F.abs(F.col("band") - F.col("prediction")).alias("ea")).join(
        b.select("row_key", F.abs(F.col("band") - F.col("prediction")).alias("eb")), "row_key")
    groups = rows.groupBy("group_id").agg(F.sum(F.col("eb") - F.col("ea")).alias("d"), F.count(F.lit(1)).alias("n"))
    point = groups.agg((F.sum("d") / F.sum("n")).alias("delta"), F.count(F.lit(1)).alias("groups")).withColumn("k", F.lit(1))
    return point.join(bootstrap_ratio(groups.withColumn("k", F.lit(1)), "group_id", "d", "n", ["k"], replicates), "k").drop("k")


def changed_rows(prepared: DataFrame) -> DataFrame:
    """Rows whose conservative and permissive skill lists differ."""
    return prepared.agg(F.count_if(F.col("skills") != F.col("skills_permissive")).alias("changed"), F.count(F.lit(1)).alias("rows"))


def calibration_error(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error of `scored(p, y)` over equal-width bins, one row."""
    width = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per_bin = scored.groupBy(width.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return per_bin.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def best_temperature(scored: DataFrame, steps: int = 120, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """Temperature with the smallest mean log loss of `scored(logit, y)` over a logarithmic grid, the smallest of equals.

    All grid sums come from one pass over the rows.
    """
    import math

    grid = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (steps - 1)) for i in range(steps)]

    def loss(t: float) -> Column:
        z = F.col("logit") / t
        return F.avg(F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z))))

    row = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.col(f"t{i}").alias("nll"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)])
    return row.select(F.array_min(pairs).alias("b")).select("b.temperature", "b.nll")


def company_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean absolute error of predicting pay by the median of the same title, else of all; one row."""
    by_title = exact_quantiles(train, ["title"], "pay", {"m": 0.5})
    overall = exact_quantiles(train, [], "pay", {"m": 0.5}).scalar()
    return test.join(by_title, "title", "left").agg(
        F.avg(F.abs(F.col("pay") - F.coalesce("m", overall))).alias("mae"), F.count(F.lit(1)).alias("rows"))


def variance_components(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Share of variance between groups from one-way sums of squares, one row."""
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"))
    ms_within = F.col("within") / (F.col("N") - F.col("k"))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    var_between = F.greatest((F.col("between") / (F.col("k") - 1) - ms_within) / n0, F.lit(0.0))
    return total.select(F.col("k").alias("groups"), F.col("N").alias("rows"), (var_between / (var_between + ms_within)).alias("icc"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation by average ranks, one row.

    The values are written out first: sums of doubles may come out differently when computed again, and would not join.
    """
    rows = cut(rows.select(a, b))
    ra = average_ranks(rows, [], a).select(a, F.col("avg_rank").alias("ra"))
    rb = average_ranks(rows, [], b).select(b, F.col("avg_rank").alias("rb"))
    return rows.join(ra, a).join(rb, b).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def weighted_pay_fit(train: DataFrame, test: DataFrame, weight: str) -> DataFrame:
    """Error of a weighted log-pay regression on title and experience, one row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [StringIndexer(inputCol="title", outputCol="_t", handleInvalid="keep"), OneHotEncoder(inputCols=["_t"], outputCols=["_tv"]),
              VectorAssembler(inputCols=["_tv", "experience"], outputCol="_x"),
              LinearRegression(featuresCol="_x", labelCol="_y", weightCol=weight)]
    model = Pipeline(stages=stages).fit(train.withColumn("_y", F.log("pay")))
    return model.transform(test.withColumn("_y", F.log("pay"))).agg(F.avg(F.abs(F.exp("prediction") - F.col("pay"))).alias("mae"))


def band_answers(requests: DataFrame, prepared: DataFrame, predictions: DataFrame, radius: Column, min_rows: int = 20) -> DataFrame:
    """Band set and observed band counts per request; needs a specific family and enough comparable rows.

    `requests(request_id, family, experience)`, `predictions(request_id, prediction)`.
    """
    pool = scenario_pool(requests, prepared)
    counts = pool.groupBy("request_id", "band").agg(F.count(F.lit(1)).alias("n"))
    observed = counts.groupBy("request_id").agg(
        F.sum("n").alias("support"), F.array_sort(F.collect_list(F.struct("band", "n"))).alias("observed"))
    rows = requests.join(observed, "request_id", "left").join(predictions, "request_id", "left").withColumn(
        "support", F.coalesce("support", F.lit(0)))
    available = (F.col("support") >= min_rows) & ~F.col("family").isin("All", "Other")
    sets = with_band_sets(rows.withColumn("band", F.lit(0)), radius)
    return sets.select("request_id", "family", "experience", "support", available.alias("available"),
                       *[F.when(available, F.col(c)).alias(c) for c in ("prediction", "set_low", "set_high", "observed")])


def scenario_pool(requests: DataFrame, prepared: DataFrame, complete_only: bool = False) -> DataFrame:
    """Postings of each request's family whose experience range holds the request's years.

    The range join becomes an equi-join on whole years, exploded from each posting's range; the exact bounds are checked
    after. Family All matches every family through a second copy of each posting row.
    """
    rows = prepared.filter(~F.col("quality_flag"))
    if complete_only:
        rows = rows.filter(~F.col("skills_truncated"))
    years = F.explode(F.sequence(F.floor("exp_min").cast("int"), F.floor("exp_max").cast("int"))).alias("_year")
    spread = rows.select(*prepared.columns, years).withColumn("_family", F.explode(F.array(F.lit("All"), F.col("role_family"))))
    asked = requests.select("request_id", F.col("family").alias("_family"), F.col("experience").alias("_x"), F.floor("experience").cast("int").alias("_year"))
    joined = spread.join(asked, ["_family", "_year"])
    return joined.filter((F.col("exp_min") <= F.col("_x")) & (F.col("exp_max") >= F.col("_x"))).drop("_family", "_year", "_x")


def vocabulary_evidence(owned: DataFrame, pools: DataFrame) -> DataFrame:
    """Submitted skills and those seen in each request's pool; `owned(request_id, skill)`, `pools(request_id, skills)`."""
    seen = pools.select("request_id", F.explode("skills").alias("skill")).distinct().withColumn("seen", F.lit(1))
    return owned.distinct().join(seen, ["request_id", "skill"], "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("submitted"), F.count("seen").alias("observed"),
        (F.count("seen") / F.count(F.lit(1))).alias("fraction"))


def method_roll_up(values: DataFrame) -> DataFrame:
    """Better, equal and worse scenario counts of each method against frequency, with the median difference.

    `values(method, request_id, F)`.
    """
    plain = values.filter("method = 'frequency'").select("request_id", F.col("F").alias("plain"))
    rows = values.filter("method <> 'frequency'").join(plain, "request_id").withColumn("delta", F.col("F") - F.col("plain"))
    counts = rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("scenarios"), F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") == 0).alias("equal"),
        F.count_if(F.col("delta") < 0).alias("worse"))
    return counts.join(exact_quantiles(rows, ["method"], "delta", {"median_delta": 0.5}), "method")


def exchange_rows(prepared: DataFrame) -> DataFrame:
    """Numeric extract: skill count, keyword flags, booleans as 0/1."""
    return prepared.select(
        "row_key", "group_id", "split", "band", "exp_min", "exp_max", "exp_mid", F.size("skills").cast("long").alias("skill_count"),
        F.exists("skills", lambda s: s.contains("stat")).cast("int").alias("statistics"),
        F.exists("skills", lambda s: s.contains("model")).cast("int").alias("modelling"),
        F.col("skills_truncated").cast("int").alias("skills_truncated"), F.col("quality_flag").cast("int").alias("quality_flag"),
        "multiplicity")


def partition_audit(prepared: DataFrame) -> DataFrame:
    """Rows, groups, duplicates removed and rows per split, as (measure, n)."""
    row = prepared.agg(
        F.count(F.lit(1)).alias("prepared_rows"), (F.sum("multiplicity") - F.count(F.lit(1))).alias("copies_removed"),
        F.countDistinct("group_id").alias("groups"), F.count_if("skills_truncated").alias("skills_truncated"),
        F.count_if("quality_flag").alias("quality_flagged"),
        *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s, _ in num.BAND_SPLIT])
    return row.unpivot([], row.columns, "measure", "n")
