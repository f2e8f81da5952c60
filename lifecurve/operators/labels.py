"""Gates, exclusion cascade, human overrides and horizon labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.functions.scalars import cohort_two_way
from lifecurve.operators.ordered import Ordered, arrange, join_on
from lifecurve.operators.series import FADE_THRESHOLD, RECOVERY_MIN, sticky_fade

# Fixed values of the gates and labels.
EARLY_WINDOW = 5
LOW_CAPACITY = 0.1
HORIZONS = (200, 300, 400)


def horizon_label(status: Column, last_fade: Column, n_regular: Column, n: int) -> Column:
    """pass / bad / censor / excluded at horizon ``n``; a fade exactly at ``n`` is bad."""
    return (
        F.when(status == "faded", F.when(last_fade > n, "pass").otherwise("bad"))
        .when(status == "in_testing", F.when(n_regular >= n, "pass").otherwise("censor"))
        .otherwise("excluded")
    )


def with_horizon_labels(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    for n in horizons:
        label = horizon_label(F.col("status"), F.col("last_fade_cycle"), F.col("n_regular"), n)
        df = df.withColumn(f"label_n{n}", label)
        df = df.withColumn(f"trainable_n{n}", F.col(f"label_n{n}").isin("pass", "bad"))
    return df


def true_pass(status: Column, last_fade: Column, n_regular: Column, n: int) -> Column:
    """Three-valued truth: a fade exactly at ``n`` passes here; null when not known."""
    return (
        F.when(status == "excluded", F.lit(None).cast("double"))
        .when(status == "faded", F.when(last_fade >= n, 1.0).otherwise(0.0))
        .when(n_regular >= n, 1.0)
    )


def low_initial(o: Ordered, entity: str, position: str, columns: Sequence[str]) -> DataFrame:
    """``low_initial``: one of the first five rows has a measured value below the limit."""
    early = F.col(position) <= EARLY_WINDOW
    low = F.lit(False)
    for c in columns:
        low = low | F.coalesce(F.col(c) < LOW_CAPACITY, F.lit(False))
    return o.rows().groupBy(entity).agg(F.bool_or(early & low).alias("low_initial"))


def build_labels(
    cells: DataFrame,
    cycles: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    discharge: str = "capacity_discharge_ah",
    charge: str = "capacity_charge_ah",
    decisions: DataFrame | None = None,
    outliers: DataFrame | None = None,
    baseline_cycle: int = 1,
    horizons: Sequence[int] = HORIZONS,
    cohort: Column | None = None,
    threshold: float = FADE_THRESHOLD,
    recovery_min: int = RECOVERY_MIN,
    bound: int | None = None,
) -> DataFrame:
    """One label row per cell.

    ``cells``: entity, cycling_consistency, protocol_pattern, first_regime_n.
    ``cycles``: entity, ordinal, discharge, charge (regular rows only, discharge not null).
    ``decisions``: entity, exclude_from_ml, last_available_cycle, event_type.
    ``outliers``: entity, ordinal of masked rows.
    """
    spark = cells.sparkSession
    kind = dict(cycles.select(entity, cycle).dtypes)
    if decisions is None:
        decisions = spark.createDataFrame(
            [], f"{entity} {kind[entity]}, exclude_from_ml boolean, last_available_cycle long, event_type string"
        )
    rows = cycles.select(entity, cycle, discharge, charge)
    if outliers is None:
        rows = rows.withColumn("_masked", F.lit(False))
    else:
        marks = outliers.select(entity, cycle).distinct().withColumn("_hit", F.lit(True))
        rows = join_on(rows, marks, [entity, cycle], "left").select(
            entity, cycle, discharge, charge, F.coalesce("_hit", F.lit(False)).alias("_masked")
        )
    c = F.col(cycle)
    lac = F.col("last_available_cycle")
    o = arrange(rows, [entity], [cycle], bound=bound).position("_pos")
    o = o.join_facts(decisions.select(entity, "last_available_cycle"))
    o = o.attach(_base=F.max(F.when(c == baseline_cycle, F.col(discharge))))
    o = o.add(_in_range=(c >= baseline_cycle) & (lac.isNull() | (c <= lac)))

    early_low = (F.col("_pos") <= EARLY_WINDOW) & (
        (F.col(discharge) < LOW_CAPACITY) | F.coalesce(F.col(charge) < LOW_CAPACITY, F.lit(False))
    )
    facts = o.rows().groupBy(entity).agg(
        F.max(c).alias("_n_full"),
        F.max("_base").alias("_baseline"),
        F.bool_or(early_low).alias("_low"),
        F.max_by(discharge, F.when(lac.isNull() | (c <= lac), c)).alias("_at_target"),
        F.count_if(F.col("_in_range") & ~F.col("_masked")).alias("_n_window"),
        F.count_if(F.col("_in_range") & F.col("_masked")).alias("_n_masked"),
    )
    curve = o.where(F.col("_in_range") & ~F.col("_masked") & (F.col("_base") > 0)).add(
        retention=F.col(discharge) / F.col("_base")
    )
    fade = sticky_fade(curve, entity, cycle, "retention", threshold, recovery_min).select(
        entity, "last_fade", "n_recovered", "final_retention"
    )

    j = join_on(cells, facts, [entity], "left")
    j = join_on(j, fade, [entity], "left")
    j = join_on(
        j,
        decisions.select(entity, "exclude_from_ml", "last_available_cycle", "event_type"),
        [entity],
        "left",
    )
    consistency = F.coalesce(F.col("cycling_consistency"), F.lit("no_regular"))
    has_base = F.coalesce(F.col("_baseline") > 0, F.lit(False))
    reason = (
        F.when(consistency == "rate_changed", "rate_changed")
        .when(consistency == "no_regular", "no_regular")
        .when(F.coalesce("exclude_from_ml", F.lit(False)), "human_review")
        .when(F.col("_n_full").isNull(), "no_baseline")
        .when(F.col("_low"), "low_initial_capacity")
        .when(~has_base, "no_baseline")
    )
    override = F.coalesce(F.col("event_type").isin("event", "censor"), F.lit(False))
    target = F.coalesce(lac, F.col("_n_full"))
    j = j.withColumn("_gate", reason).withColumn("_override", F.col("_gate").isNull() & override)
    j = j.withColumn(
        "exclusion_reason",
        F.when(F.col("_gate").isNotNull(), F.col("_gate")).when(
            ~F.col("_override") & (F.col("_n_window") == 0), "no_baseline"
        ),
    )
    kept = F.col("exclusion_reason").isNull()
    auto = kept & ~F.col("_override")
    admitted = (
        (F.col("exclusion_reason") == "rate_changed")
        & (F.col("first_regime_n") >= EARLY_WINDOW)
        & has_base
    )
    last_fade = F.when(
        kept,
        F.when(F.col("_override"), F.when(F.col("event_type") == "event", target)).otherwise(
            F.col("last_fade")
        ),
    )
    out = j.select(
        entity,
        (cohort if cohort is not None else cohort_two_way(F.col(entity))).alias("cohort"),
        "protocol_pattern",
        consistency.alias("cycling_consistency"),
        F.when(consistency == "rate_changed", F.col("first_regime_n")).alias("n_regular_pre_rate_change"),
        F.when(~kept, "excluded").when(last_fade.isNotNull(), "faded").otherwise("in_testing").alias("status"),
        "exclusion_reason",
        last_fade.alias("last_fade_cycle"),
        F.coalesce(
            F.when(kept & F.col("_override"), target)
            .when(kept, F.least("_n_full", lac))
            .when(admitted, F.col("_n_full")),
            F.lit(0),
        ).alias("n_regular"),
        F.when(kept | admitted, F.col("_baseline")).alias("baseline_dis_ah"),
        F.when(kept & F.col("_override"), F.try_divide(F.col("_at_target"), F.col("_baseline")))
        .when(kept, F.col("final_retention"))
        .alias("final_retention"),
        F.when(auto, F.col("n_recovered")).otherwise(0).alias("n_recovered_crossings"),
        F.when(kept, lac).alias("truncation_cycle"),
        F.when(auto, F.col("_n_masked")).otherwise(0).alias("n_outliers_masked"),
    )
    return with_horizon_labels(out, horizons)


def feature_window(
    cells: DataFrame,
    cycles: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    discharge: str = "capacity_discharge_ah",
    charge: str = "capacity_charge_ah",
    efficiency: str = "coulombic_efficiency",
    baseline_cycle: int = 1,
    bound: int | None = None,
) -> DataFrame:
    """Rows of the feature window of every eligible entity, with its baselines.

    The window is the first five rows (by order, not by ordinal) from the baseline ordinal on. The
    first row must be ordinal 1, all inputs of the five rows must be present, and both baselines positive.
    """
    c = F.col(cycle)
    allowed = cells.where(
        (F.col("cycling_consistency") == "single_rate")
        | ((F.col("cycling_consistency") == "rate_changed") & (F.col("first_regime_n") >= EARLY_WINDOW))
    ).select(entity)
    rows = cycles.join(allowed, entity, "left_semi")
    early = arrange(rows, [entity], [cycle], bound=bound).position("_pos")
    early = early.where(F.col("_pos") <= EARLY_WINDOW).rows()
    five = Window.partitionBy(entity)  # at most five rows
    at_base = c == baseline_cycle
    complete = F.col(efficiency).isNotNull() & F.col(charge).isNotNull() & F.col(discharge).isNotNull()
    return (
        early.select(
            "*",
            F.count_if(complete).over(five).alias("_complete"),
            F.min(c).over(five).alias("_first"),
            F.max(F.when(at_base, F.col(discharge))).over(five).alias("baseline_discharge"),
            F.max(F.when(at_base, F.col(charge))).over(five).alias("baseline_charge"),
        )
        .where(
            (F.col("_complete") == EARLY_WINDOW)
            & (F.col("_first") == 1)
            & (F.col("baseline_discharge") > 0)
            & (F.col("baseline_charge") > 0)
            & (c >= baseline_cycle)
        )
        .drop("_complete", "_first", "_pos")
    )


def tier_a(
    window: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    discharge: str = "capacity_discharge_ah",
    charge: str = "capacity_charge_ah",
    efficiency: str = "coulombic_efficiency",
) -> DataFrame:
    """Efficiency (percent) and discharge retention at the end, smallest charge retention."""
    return window.groupBy(entity).agg(
        (F.max_by(efficiency, cycle) * 100.0).alias("coulombic_efficiency_final"),
        (F.max_by(discharge, cycle) / F.max("baseline_discharge")).alias("discharge_capacity_retention_final"),
        (F.min(charge) / F.max("baseline_charge")).alias("charge_capacity_retention_min"),
    )


def learning_table(
    labels: DataFrame,
    features: DataFrame,
    n: int,
    *,
    entity: str = "cell_name",
    drop_excluded: bool = True,
    min_n_regular: int = 0,
) -> DataFrame:
    """Labels and features in one wide table with masks and targets as columns."""
    df = labels.join(features, entity, "inner")
    if drop_excluded:
        df = df.where(F.col("status") != "excluded")
    if min_n_regular > 0:
        df = df.where(F.col("n_regular") >= min_n_regular)
    event = F.col("status") == "faded"
    df = df.withColumns(
        {
            "event": event,
            "time": F.when(event, F.col("last_fade_cycle")).otherwise(F.col("n_regular")),
            "y_cycle": F.when(event, F.col("last_fade_cycle").cast("double")),
            "y_class": (F.col(f"label_n{n}") == "pass").cast("int"),
            "mask_classification": F.col(f"trainable_n{n}"),
            "mask_regression": event,
            "mask_survival": F.col("status") != "excluded",
        }
    )
    return df


def task_view(df: DataFrame, task: str) -> DataFrame:
    """Rows a task may train on."""
    if task not in ("classification", "regression", "survival"):
        raise ValueError(f"unknown task {task!r}")
    return df.where(F.col(f"mask_{task}"))


def train_and_score_masks(df: DataFrame, train_min: int = 6, score_min: int = 5) -> DataFrame:
    """Training needs a longer history and no exclusion; scoring takes every row long enough."""
    return df.withColumn(
        "may_train", (F.col("n_regular") >= train_min) & (F.col("status") != "excluded")
    ).withColumn("may_score", F.col("n_regular") >= score_min)
