"""Pay ranges from grouped quantiles with back-off, their calibration and the bias of disclosed pay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.distributed import average_ranks, cumulative, exact_quantiles, order_statistic, weighted_quantiles
from talentgrid.session import broadcast_if_small, cut

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
MIN_SUPPORT = 20


def range_levels(train: DataFrame, levels: Sequence[Sequence[str]], value: str = "y") -> list[tuple[list[str], DataFrame]]:
    """Quantile table per back-off level, from the finest key set to the coarsest; keys must not be null.

    The tables hold one row per cell and are written out, so scoring rows never refits them.
    """
    out = []
    for keys in levels:
        sizes = train.groupBy(*keys).agg(F.count(value).alias("n"))
        out.append((list(keys), cut(exact_quantiles(train, keys, value, QUANTILES).join(sizes, list(keys)))))
    return out


def predict_range(
    rows: DataFrame, train: DataFrame, levels: Sequence[Sequence[str]], value: str = "y", min_support: int = MIN_SUPPORT
) -> DataFrame:
    """P10, P50 and P90 of each row from the finest level with enough training rows, else from all of them."""
    out, found = rows, []
    for i, (keys, table) in enumerate(range_levels(train, levels, value)):
        hit = table.filter(F.col("n") >= min_support).select(*keys, F.struct(*QUANTILES).alias(f"_q{i}"))
        out = out.join(hit, keys, "left")
        found.append(F.col(f"_q{i}"))
    overall = cut(exact_quantiles(train, [], value, QUANTILES)).select(F.struct(*QUANTILES).alias("q")).scalar()
    best = out.withColumn("_q", F.coalesce(*found, overall))
    ordered = F.array_sort(F.array(*[F.col(f"_q.{q}") for q in QUANTILES]))
    return best.select(*rows.columns, *[ordered[i].alias(q) for i, q in enumerate(QUANTILES)])


def conformal_margin(calibration: DataFrame, value: str = "y", coverage: float = 0.8) -> DataFrame:
    """One row: the correction that gives the P10-P90 band its target coverage on new rows."""
    scores = calibration.select(F.greatest(F.col("p10") - F.col(value), F.col(value) - F.col("p90")).alias("score"))
    n = F.col("total")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * coverage) / n)
    return order_statistic(scores, [], "score", F.ceil(level * (n - 1)), "margin")


def interval_quality(rows: DataFrame, keys: Sequence[str] = (), value: str = "y", min_rows: int = 1) -> DataFrame:
    """Error, coverage before and after the margin, and width of log-space ranges, per key.

    Rows carry value, p10, p50, p90 and margin; money is exp(log).
    """
    low, high = F.col("p10") - F.col("margin"), F.col("p90") + F.col("margin")
    y = F.exp(value)
    marked = rows.withColumns({
        "abs_error": F.abs(F.exp("p50") - y), "pct_error": F.abs(F.exp("p50") - y) / y * 100,
        "in_raw": F.col(value).between(F.col("p10"), F.col("p90")), "in_calibrated": (F.col(value) >= low) & (F.col(value) <= high),
        "width": F.exp(high) - F.exp(low), "width_ratio": F.exp(high) / F.exp(low),
    })
    measures = {"mdape_pct": "pct_error", "median_width": "width", "median_width_ratio": "width_ratio"}
    long = marked.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("_measure"), F.col(c).alias("_v")) for name, c in measures.items()])))
    medians = exact_quantiles(long, [*keys, "_measure"], "_v", {"_m": 0.5}).groupBy(*keys).agg(*[
        F.max(F.when(F.col("_measure") == name, F.col("_m"))).alias(name) for name in measures])
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"), F.avg(F.col("in_raw").cast("double")).alias("coverage_raw"),
        F.avg(F.col("in_calibrated").cast("double")).alias("coverage_calibrated")).filter(F.col("n") >= min_rows)
    if keys:
        return out.join(medians, list(keys))
    row = medians.select(F.struct(*measures).alias("m")).scalar()
    return out.withColumn("_m", row).select(*out.columns, *[F.col(f"_m.{name}").alias(name) for name in measures])


def pinball_loss(rows: DataFrame, value: str = "y") -> DataFrame:
    """Mean pinball loss of each quantile column, one row."""
    def loss(q: str, a: float) -> Column:
        d = F.col(value) - F.col(q)
        return F.avg(F.greatest(a * d, (a - 1) * d)).alias(q)

    return rows.agg(*[loss(q, a) for q, a in QUANTILES.items()])


def backoff_median(rows: DataFrame, train: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str = "y") -> DataFrame:
    """Median of the same fine cell, else of the coarse cell, else of everything."""
    a = exact_quantiles(train, fine, value, {"_fine": 0.5})
    c = exact_quantiles(train, coarse, value, {"_coarse": 0.5})
    overall = exact_quantiles(train, [], value, {"m": 0.5}).scalar()
    return rows.join(a, list(fine), "left").join(c, list(coarse), "left").withColumn(
        "baseline", F.coalesce("_fine", "_coarse", overall)).drop("_fine", "_coarse")


def support_counts(rows: DataFrame, code: str, tier: str) -> DataFrame:
    """Disclosed rows per (code, tier) and pooled over tiers (tier null)."""
    return rows.rollup(code, tier).agg(F.count(F.lit(1)).alias("n_support")).filter(F.col(code).isNotNull())


def pay_answers(requests: DataFrame, ranges: DataFrame, support: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Range and support of each request; without a tier the support is pooled over tiers.

    `ranges` are the requests with p10, p50 and p90; `support` comes from `support_counts` over (code, tier).
    """
    pooled = support.filter(F.col("tier").isNull()).select("code", F.col("n_support").alias("pooled"))
    exact = support.filter(F.col("tier").isNotNull())
    joined = ranges.join(exact, ["code", "tier"], "left").join(pooled, "code", "left")
    n = F.coalesce(F.when(F.col("tier").isNull(), F.col("pooled")).otherwise(F.col("n_support")), F.lit(0))
    return joined.select(
        *requests.columns, *[F.bround(F.exp(q), -3).alias(q) for q in QUANTILES], n.alias("n_support"),
        (n >= min_support).alias("sufficient"))


def pay_summary(rows: DataFrame, keys: Sequence[str], min_support: int = MIN_SUPPORT) -> DataFrame:
    """Medians of the posting ranges of any posting set, disclosed count and whether it suffices."""
    out = rows.groupBy(*keys).agg(F.count_if("disclosed").alias("n_support"))
    for q in QUANTILES:
        out = out.join(exact_quantiles(rows, list(keys), q, {q: 0.5}).withColumn(q, F.bround(q, -3)), list(keys))
    return out.withColumn("sufficient", F.col("n_support") >= min_support)


def contingency(df: DataFrame, factor: str, outcome: str) -> DataFrame:
    """Counts of a factor level by boolean outcome, with expected counts under independence."""
    cells = df.groupBy(factor).agg(F.count_if(outcome).alias("yes"), F.count_if(~F.col(outcome)).alias("no"))
    whole = Window.partitionBy()
    long = cells.select(factor, F.inline(F.array(
        F.struct(F.lit(True).alias("outcome"), F.col("yes").alias("n")), F.struct(F.lit(False).alias("outcome"), F.col("no").alias("n")))))
    # The windows run over the aggregated cells: levels of the factor times two.
    rows, columns = F.sum("n").over(Window.partitionBy(factor)), F.sum("n").over(Window.partitionBy("outcome"))
    return long.withColumns({"expected": rows * columns / F.sum("n").over(whole), "total": F.sum("n").over(whole)})


def association(df: DataFrame, factor: str, outcome: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and Cramér's V of a factor against a boolean outcome, one row."""
    cells = contingency(df, factor, outcome)
    chi2 = F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected"))
    levels = F.countDistinct(factor)
    return cells.agg(chi2.alias("chi2"), (levels - 1).alias("dof"), F.max("total").alias("total")).select(
        "chi2", "dof", F.sqrt(F.col("chi2") / F.col("total")).alias("cramers_v"))


def chi_square_p(df: DataFrame, factor: str, outcome: str) -> DataFrame:
    """p value of the same test from the cluster's own chi-square test."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    indexed = StringIndexer(inputCol=factor, outputCol="_f").fit(df).transform(df.withColumn("_y", F.col(outcome).cast("double")))
    vectors = VectorAssembler(inputCols=["_f"], outputCol="_v").transform(indexed)
    return ChiSquareTest.test(vectors, "_v", "_y", flatten=True).select("pValue", "degreesOfFreedom", "statistic")


def disclosure_rates(df: DataFrame, factor: str, outcome: str, min_rows: int = 200) -> DataFrame:
    return df.groupBy(factor).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(outcome).cast("double")).alias("rate")).filter(
        F.col("rows") >= min_rows)


def mean_difference(df: DataFrame, value: str, outcome: str) -> DataFrame:
    """Group means and the standardised mean difference between outcome true and false, one row."""
    yes, no = F.when(F.col(outcome), F.col(value)), F.when(~F.col(outcome), F.col(value))
    return df.agg(
        F.avg(yes).alias("mean_true"), F.avg(no).alias("mean_false"),
        ((F.avg(yes) - F.avg(no)) / F.sqrt((F.var_samp(yes) + F.var_samp(no)) / 2)).alias("smd"))


def ks_statistic(df: DataFrame, value: str, outcome: str) -> DataFrame:
    """Largest difference between the two empirical distribution functions, one row."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("_yes", F.col(outcome).cast("long"))
    everyone = cumulative(rows, [], value)
    yes = cumulative(rows, [], value, weight="_yes").select(
        value, F.col("n").alias("yn"), F.col("before").alias("yb"), F.col("total").alias("yt"))
    both = everyone.join(yes, value)
    at_yes = (F.col("yb") + F.col("yn")) / F.col("yt")
    at_no = (F.col("before") + F.col("n") - F.col("yb") - F.col("yn")) / (F.col("total") - F.col("yt"))
    return both.agg(F.max(F.abs(at_yes - at_no)).alias("ks"))


def auc(df: DataFrame, score: str, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks, per key."""
    ranks = average_ranks(df, keys, score).select(*keys, score, "avg_rank")
    positives = df.filter(F.col(outcome)).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("p"))
    sums = ranks.join(positives, [*keys, score]).groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = sums.join(sizes, list(keys)) if keys else sums.withColumn("n", sizes.scalar())
    return both.select(
        *keys, ((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"))


def disclosure_propensity(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], outcome: str, fold: Column, folds: int = 5
) -> DataFrame:
    """Cross-fitted probability of disclosure: each fold is scored by a model fitted on the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # Rows alike in all that a model sees are one row with their number, so every pass of a fit reads a table of cells.
    features = [*categorical, *numeric]
    rows = df.withColumns({"_fold": fold, "_label": F.col(outcome).cast("double")})
    cells = cut(rows.groupBy(*features, "_fold", "_label").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    # Categories are numbered in their own order; by frequency, cells would be counted instead of rows.
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    stages += [OneHotEncoder(inputCols=[f"_{c}_i" for c in categorical], outputCols=[f"_{c}_v" for c in categorical])]
    stages += [VectorAssembler(inputCols=[f"_{c}_v" for c in categorical] + list(numeric), outputCol="_x", handleInvalid="keep")]
    stages += [LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_n", maxIter=20)]
    asked = cells.select(*features, "_fold").distinct()
    out = None
    for f in range(folds):
        model = Pipeline(stages=stages).fit(cells.filter(F.col("_fold") != f))
        scored = model.transform(asked.filter(F.col("_fold") == f)).select(
            *[F.col(c).alias(f"_of_{c}") for c in [*features, "_fold"]], vector_to_array("probability")[1].alias("propensity"))
        out = scored if out is None else out.unionByName(scored)
    alike = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*features, "_fold"]]
    return rows.join(broadcast_if_small(out), alike).select(*df.columns, "propensity")


def _weighted_medians(rows: DataFrame, train: DataFrame, levels: Sequence[Sequence[str]], value: str, weight: str, min_support: int, name: str) -> DataFrame:
    """Rows with the weighted median of their finest level with enough training rows, else of all."""
    out, found = rows, []
    for i, keys in enumerate(levels):
        sizes = train.groupBy(*keys).agg(F.count(value).alias("_n")).filter(F.col("_n") >= min_support)
        table = cut(weighted_quantiles(train, keys, value, weight, {f"_m{i}": 0.5}).join(sizes.drop("_n"), list(keys)))
        out = out.join(table, list(keys), "left")
        found.append(F.col(f"_m{i}"))
    overall = cut(weighted_quantiles(train, [], value, weight, {"m": 0.5})).scalar()
    return out.withColumn(name, F.coalesce(*found, overall)).select(*rows.columns, name)


def propensity_shift(
    scored: DataFrame, levels: Sequence[Sequence[str]], split: str = "split", outcome: str = "disclosed", value: str = "y", least: float = 0.05,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """How far predicted pay moves when disclosed rows are weighted to stand for all rows, one row.

    `scored` holds all rows with `propensity`, the log pay `value` where it is disclosed, and their split. Training rows
    weigh 1 / propensity, which is taken as `least` where it is lower. Medians with and without weights use one rule.
    Columns: median and mean change in per cent of the undisclosed rows, mean absolute error of the test rows either way.
    """
    rows = scored.withColumns({"_one": F.lit(1.0), "_w": 1 / F.greatest(F.lit(least), F.least(F.lit(1.0), "propensity"))})
    train = rows.filter(F.col(outcome) & (F.col(split) == "train"))
    asked = rows.filter(~F.col(outcome) | (F.col(split) == "test"))
    plain = _weighted_medians(asked, train, levels, value, "_one", min_support, "_plain")
    both = cut(_weighted_medians(plain, train, levels, value, "_w", min_support, "_weighted"))
    change = both.filter(~F.col(outcome)).select(((F.exp("_weighted") / F.exp("_plain") - 1) * 100).alias("change"))
    middle = exact_quantiles(change, [], "change", {"median_change_pct": 0.5}).scalar()
    error = lambda name: F.avg(F.when(F.col(outcome), F.abs(F.exp(name) - F.exp(value))))
    sums = both.agg(
        F.avg(F.when(~F.col(outcome), (F.exp("_weighted") / F.exp("_plain") - 1) * 100)).alias("mean_change_pct"),
        error("_plain").alias("test_mae"), error("_weighted").alias("test_mae_weighted"), F.count_if(~F.col(outcome)).alias("undisclosed"))
    return sums.select(middle.alias("median_change_pct"), "mean_change_pct", "test_mae", "test_mae_weighted", "undisclosed")


def pay_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], texts: Sequence[str], dims: int = 32) -> DataFrame:
    """Feature vector per row: indexed categories, numbers, and each word list as TF-IDF reduced to `dims` components.

    A list of fewer different words keeps a component for each.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, PCA, CountVectorizer, StringIndexer, VectorAssembler

    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categorical]
    for t in texts:
        counted = CountVectorizer(inputCol=t, outputCol=f"_{t}_tf", minDF=2.0, vocabSize=1 << 18).fit(df)
        stages += [counted, IDF(inputCol=f"_{t}_tf", outputCol=f"_{t}_idf"),
                   PCA(k=min(dims, len(counted.vocabulary)), inputCol=f"_{t}_idf", outputCol=f"_{t}_pca")]
    stages += [VectorAssembler(inputCols=[f"_{c}" for c in categorical] + list(numeric) + [f"_{t}_pca" for t in texts],
                               outputCol="features", handleInvalid="keep")]
    return Pipeline(stages=stages).fit(df).transform(df)
