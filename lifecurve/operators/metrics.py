"""Classification and regression metrics, for the whole and per cohort.

Rows are combined per distinct (cohort, outcome, score) before anything is ordered or repeated for
the overall scope, so one huge cohort is reduced on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.ordered import join_same, with_single
from lifecurve.operators.ranks import auc_from_counts, exact_quantiles, with_scopes
from lifecurve.session import materialize


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    n = tp + fp + fn + tn
    return [
        ratio_or_zero(tp + tn, n).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio_or_zero(2 * tn, 2 * tn + fp + fn).alias("f1_negative"),
    ]


def classification_metrics(
    df: DataFrame, keys: Sequence[str], label: str, pred: str, score: str, cohort: str, *, bound: int | None = None
) -> DataFrame:
    """n, accuracy, precision, recall, F1 of both classes and ROC-AUC; scope ``all`` and per cohort."""
    combined = df.groupBy(
        *keys,
        F.col(cohort).alias("_cohort"),
        F.col(label).cast("int").alias("_y"),
        F.col(pred).cast("int").alias("_yhat"),
        F.col(score).cast("double").alias("_s"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    scoped = with_scopes(combined, "_cohort")
    at = [*keys, "scope"]

    def count(y, yhat):
        return F.sum(F.when((F.col("_y") == y) & (F.col("_yhat") == yhat), F.col("_n")).otherwise(0))

    cells = scoped.groupBy(*at).agg(
        F.sum("_n").alias("n"),
        count(1, 1).alias("_tp"),
        count(0, 1).alias("_fp"),
        count(1, 0).alias("_fn"),
        count(0, 0).alias("_tn"),
    )
    by_score = scoped.groupBy(*at, "_s").agg(
        F.sum(F.when(F.col("_y") == 1, F.col("_n")).otherwise(0)).cast("double").alias("_pos"),
        F.sum(F.when(F.col("_y") == 0, F.col("_n")).otherwise(0)).cast("double").alias("_neg"),
    )
    auc = auc_from_counts(by_score, at, bound=bound).withColumnRenamed("auc", "roc_auc")
    named = confusion_metrics(*[F.col(c) for c in ("_tp", "_fp", "_fn", "_tn")])
    return join_same(cells, auc, at).select(*at, "n", *named, "roc_auc")


def train_test_gap(metrics: DataFrame, keys: Sequence[str], split: str, names: Sequence[str]) -> DataFrame:
    """train, test and train - test columns per metric."""

    def part(which, m):
        return F.max(F.when(F.col(split) == which, F.col(m)))

    wide = metrics.groupBy(*keys).agg(
        *[part(w, m).alias(f"{w}_{m}") for m in names for w in ("train", "test")]
    )
    return wide.select("*", *[(F.col(f"train_{m}") - F.col(f"test_{m}")).alias(f"gap_{m}") for m in names])


def regression_metrics(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, cohort: str, *, bound: int | None = None
) -> DataFrame:
    """n, MAE, RMSE, R2 and median absolute error; scope ``all`` and per cohort.

    Moments are taken once per cohort and merged for the whole; the errors are written once, narrow, so that the
    passes of the medians do not run what comes before them again.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(
        *keys, F.col(cohort).cast("string").alias("_cohort"), F.col(y).cast("double").alias("_y"), (F.col(pred) - F.col(y)).cast("double").alias("_e")
    )
    rows = materialize(rows)
    at = [*keys, "scope"]
    n, e2 = F.col("_n"), F.col("_e") * F.col("_e")
    moments = rows.groupBy(*keys, "_cohort").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs("_e")).alias("_abs"), F.sum(e2).alias("_sse"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var")
    )
    scoped = with_scopes(moments, "_cohort")
    centre = scoped.groupBy(*at).agg((F.sum(n * F.col("_mean")) / F.sum("_n")).alias("_centre"))
    gap = F.col("_mean") - F.col("_centre")
    parts = join_same(scoped, centre, at).groupBy(*at).agg(
        F.sum("_n").alias("n"),
        (F.sum("_abs") / F.sum("_n")).alias("mae"),
        F.sqrt(F.sum("_sse") / F.sum("_n")).alias("rmse"),
        (1 - F.try_divide(F.sum("_sse"), F.sum(n * (F.col("_var") + gap * gap)))).alias("r2"),
    )
    errors = with_scopes(rows.select(*keys, "_cohort", F.abs("_e").alias("_abs")), "_cohort")
    medae = exact_quantiles(errors, at, "_abs", {"medae": 0.5}, bound=bound)
    return join_same(parts, medae, at)


def mape(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Mean absolute percentage error over positive targets."""
    ok = F.when(F.col(y) > 0, F.abs(F.col(pred) - F.col(y)) / F.col(y))
    return df.groupBy(*keys).agg(F.avg(ok).alias("mape"))


def quartile_mae(df: DataFrame, keys: Sequence[str], y: str, pred: str, *, bound: int | None = None) -> DataFrame:
    """MAE inside each quarter of the true value (cuts by linear interpolation); the rows are written once, narrow."""
    df = materialize(df.select(*keys, F.col(y), F.col(pred)))
    cuts = exact_quantiles(df, keys, y, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, bound=bound)
    at = join_same(df, cuts, keys) if keys else with_single(df, cuts)
    v, err = F.col(y), F.abs(F.col(pred) - F.col(y))
    inside = {
        "mae_q1": v <= F.col("_q1"),
        "mae_q2": (v > F.col("_q1")) & (v <= F.col("_q2")),
        "mae_q3": (v > F.col("_q2")) & (v <= F.col("_q3")),
        "mae_q4": v > F.col("_q3"),
    }
    return at.groupBy(*keys).agg(*[F.avg(F.when(cond, err)).alias(n) for n, cond in inside.items()])
