"""Splits, imputation, MLlib fits, out-of-fold scores, search and importance."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.functions.scalars import clip, transform_target
from lifecurve.operators.forests import moved_aucs, read_forest
from lifecurve.operators.ordered import arrange, chunk_rows, join_same, spread_before_copies, with_single
from lifecurve.operators.ranks import exact_quantiles, roc_auc
from lifecurve.session import materialize

FEATURES_COL = "features"


# ---- splits ---------------------------------------------------------------------------------


def seeded_order(seed: int | Column, *parts: str) -> Column:
    """Repeatable random order key of a row: md5 of seed and identity."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("/", first.cast("string"), *[F.col(p).cast("string") for p in parts]))


def stratified_holdout(
    df: DataFrame, stratum: str, entity: str, *, test_share: float = 0.2, seed: int = 42, bound: int | None = None
) -> DataFrame:
    """``split`` column: the same share of every stratum is test."""
    o = arrange(df.withColumn("_h", seeded_order(seed, entity)), [stratum], ["_h", entity], bound=bound)
    o = o.position("_rank").attach(_n=F.count(F.lit(1)))
    test = F.col("_rank") <= F.ceil(F.col("_n") * test_share)
    return o.rows().withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_rank", "_n")


def stratified_folds(
    df: DataFrame, stratum: str, entity: str, *, folds: int = 5, seed: int = 42, bound: int | None = None
) -> DataFrame:
    """``fold`` column 0..folds-1, balanced within every stratum; each row is in exactly one fold."""
    o = arrange(df.withColumn("_h", seeded_order(seed, entity)), [stratum], ["_h", entity], bound=bound)
    fold = F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")
    return o.position("_rank").rows().withColumn("fold", fold).drop("_h", "_rank")


def production_split(df: DataFrame, labeled: Column) -> tuple[DataFrame, DataFrame]:
    """Train on labeled rows, score every row."""
    return df.where(labeled), df


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def fill_values(train: DataFrame, columns: Sequence[str], strategy: str, *, bound: int | None = None) -> DataFrame:
    """(feature, fill) of every column, from the training rows alone; null where a column has no value.

    The columns become rows of (feature, value), so the exact medians of all of them come from one pass with one bracket
    per feature, and modes from one count per distinct value (the smallest of the most frequent ones).
    """
    if strategy == "constant":
        one = train.agg(F.lit(0.0).alias("fill"))
        return one.select(F.explode(F.array(*map(F.lit, columns))).alias("feature"), "fill")
    long = train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    if strategy == "median":
        return exact_quantiles(long, ["feature"], "value", {"fill": 0.5}, bound=bound)
    known = long.where(F.col("value").isNotNull())
    if strategy == "mean":
        return known.groupBy("feature").agg(F.avg("value").alias("fill"))
    if strategy == "mode":
        counts = known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("feature").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("fill"))
    raise ValueError(f"unknown imputation {strategy!r}")


def filled_with(df: DataFrame, fills: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values (null or NaN) of each column replaced by its fill."""
    wide = fills.agg(*[F.max(F.when(F.col("feature") == c, F.col("fill"))).alias(f"_fill_{c}") for c in columns])
    whole = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_fill_{c}")) for c in columns}
    return with_single(df, wide).withColumns(whole).drop(*[f"_fill_{c}" for c in columns])


# ---- estimators -----------------------------------------------------------------------------


def model_pipeline(features: Sequence[str], estimator: Estimator, impute: str | None = "median") -> Pipeline:
    """Imputation fitted with the model, on the training rows only; column order fixed by the list."""
    stages: list = []
    inputs = list(features)
    if impute in ("median", "mean", "mode"):
        inputs = [f"{c}_filled" for c in features]
        stages.append(Imputer(strategy=impute, inputCols=list(features), outputCols=inputs))
    elif impute is not None:
        raise ValueError(f"unknown imputation {impute!r}; constants are filled with fill_constant")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES_COL))
    return Pipeline(stages=[*stages, estimator])


def forest_classifier(label: str, *, trees: int = 50, depth: int = 5, min_rows: int = 1, subset: str = "auto", weight: str | None = None, seed: int = 42) -> RandomForestClassifier:
    est = RandomForestClassifier(
        labelCol=label,
        featuresCol=FEATURES_COL,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_rows,
        featureSubsetStrategy=subset,
        seed=seed,
    )
    return est.setWeightCol(weight) if weight else est


def boosted_classifier(label: str, *, rounds: int = 20, depth: int = 3, step: float = 0.1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol=FEATURES_COL, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def boosted_regressor(label: str, *, rounds: int = 20, depth: int = 3, step: float = 0.1, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol=FEATURES_COL, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def life_model(time: str, event: str, **kw) -> AFTSurvivalRegression:
    """Weibull accelerated failure time; ``event`` is 1.0 for an observed end, 0.0 for censored rows."""
    return AFTSurvivalRegression(
        labelCol=time,
        censorCol=event,
        featuresCol=FEATURES_COL,
        quantileProbabilities=[0.5],
        quantilesCol="_quantiles",
        **kw,
    )


def median_life(scored: DataFrame, low: float = 1.0, high: float = 5000.0) -> DataFrame:
    """Predicted median time, clipped."""
    return scored.withColumn("median_time", clip(vector_to_array("_quantiles")[0], low, high))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (classes * rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = with_single(per, total).select(
        label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(name)
    )
    return df.join(weights, label)


def positive_probability(scored: DataFrame, name: str = "proba") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, share) of a fitted tree model, in the order of the matrix."""
    values = model.stages[-1].featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, values)]


# ---- cross-fitting --------------------------------------------------------------------------

Fit = Callable[[DataFrame], Model]


def cross_fit(df: DataFrame, fit: Fit, keep: Sequence[str], *, folds: int, fold: str = "fold", score: Callable[[DataFrame], DataFrame] = positive_probability, output: str = "proba") -> DataFrame:
    """Fit on the other folds, score this fold, stack the folds: every row is scored exactly once."""
    parts = []
    for k in range(folds):
        model = fit(df.where(F.col(fold) != k))
        parts.append(score(model.transform(df.where(F.col(fold) == k))).select(*keep, fold, output))
    return reduce(DataFrame.unionByName, parts)


def nested_scores(df: DataFrame, stratum: str, entity: str, fit_for: Callable[[int], Fit], keep: Sequence[str], *, seeds: Sequence[int], folds: int = 5, bound: int | None = None) -> DataFrame:
    """Cross-fitted scores for every seed. ``fit_for(seed)`` may search parameters on its training rows."""
    parts = []
    for seed in seeds:
        folded = stratified_folds(df, stratum, entity, folds=folds, seed=seed, bound=bound)
        scored = cross_fit(folded, fit_for(seed), list(dict.fromkeys([entity, *keep])), folds=folds)
        parts.append(scored.withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionByName, parts)


def coverage(scored: DataFrame, seed: str, entity: str) -> DataFrame:
    """Rows and entities per seed; ``once`` is true when every entity was scored exactly once."""
    per = scored.groupBy(seed, entity).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(seed).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"), (F.max("_n") == 1).alias("once")
    )


def on_spine(spine: DataFrame, scored: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Scores on every entity, null outside the training rows."""
    return spine.join(scored.select(entity, *columns), entity, "left")


def random_grid(space: Mapping[Param, Sequence], draws: int, seed: int = 42) -> list[dict[Param, object]]:
    """Distinct seeded draws from a parameter space."""
    rng, seen, out = random.Random(seed), set(), []
    size = 1
    for values in space.values():
        size *= len(values)
    while len(out) < min(draws, size):
        pick = tuple(rng.randrange(len(v)) for v in space.values())
        if pick not in seen:
            seen.add(pick)
            out.append({p: v[i] for (p, v), i in zip(space.items(), pick)})
    return out


def search(df: DataFrame, pipeline: Pipeline, space: Mapping[Param, Sequence], *, fold: str, folds: int, draws: int, evaluator: Evaluator | None = None, label: str = "label", seed: int = 42, parallelism: int = 4) -> CrossValidatorModel:
    """K-fold parameter search on a given fold column; the fits run in parallel."""
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=random_grid(space, draws, seed),
        evaluator=evaluator or BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
        seed=seed,
    )
    return validator.fit(df)


def ensemble_scores(models: Mapping[int, PipelineModel], df: DataFrame, entity: str, required: Sequence[str]) -> DataFrame:
    """Long scores (seed, entity, proba) of stored models on new rows; missing columns are refused."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")
    parts = [
        positive_probability(m.transform(df)).select(entity, "proba").withColumn("seed", F.lit(seed))
        for seed, m in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- targets and importance -----------------------------------------------------------------


def boxcox_lambda(df: DataFrame, keys: Sequence[str], y: str, *, low: float = -2.0, high: float = 2.0, points: int = 41, refine: int = 2) -> DataFrame:
    """Box-Cox lambda of largest likelihood on a grid, refined around the best point.

    Values are divided by their geometric mean; the likelihood then falls with the variance of the
    transformed values alone. Rows are combined per distinct value before each value is repeated once
    per grid point (a constant), and the copies are reduced to moments on the map side.
    """
    if points < 3:
        raise ValueError("a grid needs at least three points")
    step = (high - low) / (points - 1)
    values = df.where(F.col(y) > 0).groupBy(*keys, F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    centre = values.groupBy(*keys).agg((F.sum(F.col("_n") * F.log("_y")) / F.sum("_n")).alias("_g"))

    def with_one(rows, facts):
        return join_same(rows, facts, keys) if keys else with_single(rows, facts)

    scaled = with_one(values, centre).select(*keys, "_n", (F.col("_y") / F.exp("_g")).alias("_y"))
    scaled = spread_before_copies(scaled, *keys, "_y")
    best = None
    for level in range(refine + 1):
        if best is None:
            rows = scaled
            grid = F.array(*[F.lit(round(low + i * step, 12)) for i in range(points)])
        else:
            rows = with_one(scaled, best)
            fine = step / 10**level
            grid = F.array(*[F.round(F.col("lambda") + i * fine, 12) for i in range(-10, 11)])
        each = rows.select(*keys, "_y", "_n", F.explode(grid).alias("_l"))
        z, n = F.col("_z"), F.col("_n")
        each = each.withColumn("_z", transform_target(F.col("_y"), "boxcox", F.col("_l")))
        moments = each.groupBy(*keys, "_l").agg(
            F.sum(n).alias("_c"), F.sum(n * z).alias("_s"), F.sum(n * z * z).alias("_ss")
        )
        spread = F.col("_ss") / F.col("_c") - F.pow(F.col("_s") / F.col("_c"), F.lit(2.0))
        best = moments.withColumn("_v", spread).groupBy(*keys).agg(F.min_by("_l", F.struct("_v", "_l")).alias("lambda"))
    return best


def bijections(n: int, repeats: int, features: Sequence[str], seed: int = 42) -> list[tuple[int, str, int, int]]:
    """(repeat, feature, a, b): i -> (a i + b) mod n is a permutation of 0..n-1, as a has no factor in common with n."""
    out, top = [], min(n, (1 << 62) // max(n, 1))
    for rep, feature in product(range(1, repeats + 1), features):
        digest = hashlib.md5(f"{seed}/{rep}/{feature}".encode()).digest()
        a = 1 + int.from_bytes(digest[:8], "big") % max(1, top - 1)
        while math.gcd(a, n) > 1:
            a = a % max(1, top - 1) + 1
        out.append((rep, feature, a, int.from_bytes(digest[8:15], "big") % max(n, 1)))
    return out


def _joined_aucs(wide: DataFrame, model: PipelineModel, label: str, features: Sequence[str], maps: list[tuple[int, str, int, int]], n: int) -> DataFrame:
    """(_rep, _feature, auc): the model scores every row with every permuted value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("_feature"), F.col(f).cast("double").alias("_value")) for f in features])
    narrow = spread_before_copies(wide.select("_no", pairs.alias("_pairs")), "_no").select("_no", F.inline("_pairs"))
    table = wide.sparkSession.createDataFrame(maps, "_rep int, _feature string, _a long, _b long")
    moved = narrow.join(table, "_feature").select("_rep", "_feature", ((F.col("_a") * F.col("_no") + F.col("_b")) % max(n, 1)).alias("_no"), "_value")
    mixed = moved.join(wide, "_no").withColumns(
        {f: F.when(F.col("_feature") == f, F.col("_value")).otherwise(F.col(f)) for f in features}
    )
    scored = positive_probability(model.transform(mixed))
    return roc_auc(scored, ["_rep", "_feature"], label, "proba", bound=n)


def permutation_importance(df: DataFrame, model: PipelineModel, entity: str, label: str, features: Sequence[str], *, repeats: int = 30, seed: int = 42, bound: int | None = None) -> DataFrame:
    """Drop of AUC when one feature is permuted: mean and population std over repeats.

    Rows are numbered once, in a random order (md5 of seed and entity). Per (repeat, feature) a keyed bijection of the
    numbers says which row gets a row's value; the only ordering is that of the rows, over the whole table at every size.
    A forest behind an assembler of the features is scored by codes (``forests``), where only packed codes and scores are
    shuffled; for any other model the permuted values come by an equi join on the number. Entities are unique.
    """
    wide = arrange(df.withColumn("_h", seeded_order(seed, entity)), [], ["_h", entity], bound=bound).position("_no").rows()
    wide = materialize(wide.drop("_h").withColumn("_no", F.col("_no") - 1))
    n = wide.count()
    maps = bijections(n, repeats, features, seed)
    scored = positive_probability(model.transform(df))
    base = roc_auc(scored, [], label, "proba", bound=n).withColumnRenamed("auc", "_base")
    forest = read_forest(model, features)
    if forest is not None:
        ranges = math.ceil(n / chunk_rows(df.sparkSession))
        edges = scored.agg(F.percentile_approx("proba", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
        per = moved_aucs(wide, forest, label, features, maps, n, sorted(set(edges)))
    else:
        per = _joined_aucs(wide, model, label, features, maps, n)
    return (
        with_single(per, base)
        .withColumn("_drop", F.col("_base") - F.col("auc"))
        .groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std"))
    )


def importance_table(model: PipelineModel, features: Sequence[str], permuted: DataFrame) -> DataFrame:
    """Importance from the fitted trees and from permutation side by side, one row per feature."""
    native = permuted.sparkSession.createDataFrame(importances(model, features), "feature string, native double")
    return native.join(permuted, "feature", "left")


def stack_runs(metrics: DataFrame, fold: str = "fold", whole: int = -1) -> DataFrame:
    """Per-seed metrics of all runs stacked; only the whole-seed rows are kept."""
    return metrics.where(F.col(fold) == whole)
