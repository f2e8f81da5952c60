"""Validation and production runs on learning tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.operators import labels, learn, metrics, rollup
from lifecurve.operators.rollup import pass_rates
from lifecurve.sources.writers import wide_predictions


def validate_classifier(
    df: DataFrame,
    fit_for,
    *,
    entity: str,
    label: str,
    cohort: str,
    seeds: Sequence[int],
    folds: int = 5,
    bound: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, metrics per seed and scope, mean and std over seeds) of a nested cross-validation."""
    scores = learn.nested_scores(df, label, entity, fit_for, [label, cohort], seeds=seeds, folds=folds, bound=bound)
    scores = scores.withColumn("pred", (F.col("proba") > 0.5).cast("int"))
    per_seed = metrics.classification_metrics(scores, ["seed"], label, "pred", "proba", cohort, bound=bound)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    long = rollup.wide_to_long(per_seed, ["seed", "scope"], names)
    return scores, per_seed, rollup.across_seeds(long, ["scope", "metric"])


def production_table(
    cells: DataFrame,
    scores: Mapping[int, DataFrame],
    *,
    entity: str,
    life: DataFrame | None = None,
) -> DataFrame:
    """One row per cell: mean and std of the pass probability, the class and the truth per horizon.

    ``cells`` carries status, last_fade_cycle and n_regular. ``scores[n]`` is long (seed, entity, proba).
    """
    truth = cells.select(
        entity,
        "status",
        "n_regular",
        *[
            labels.true_pass(F.col("status"), F.col("last_fade_cycle"), F.col("n_regular"), n).alias(f"true_pass_n{n}")
            for n in scores
        ],
    )
    blocks, columns = [], ["status", "n_regular"]
    for n, long in scores.items():
        block = rollup.ensemble(long, entity, "proba", inclusive=True).select(
            entity,
            F.col("proba_mean").alias(f"prob_pass_n{n}"),
            F.col("proba_std").alias(f"prob_pass_n{n}_std"),
            F.col("pred").alias(f"pass_n{n}"),
        )
        blocks.append(block)
        columns += [f"prob_pass_n{n}", f"prob_pass_n{n}_std", f"pass_n{n}", f"true_pass_n{n}"]
    if life is not None:
        blocks.append(life)
        columns += [c for c in life.columns if c != entity]
    return wide_predictions(truth, blocks, entity, columns)


def horizon_check(table: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Predicted pass rate per horizon; it must not rise with the horizon."""
    return pass_rates(table, horizons)
