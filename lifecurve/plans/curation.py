"""Curation reports: outliers, sustained steps, jump audit and the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.functions.scalars import cohort_two_way, joined_list
from lifecurve.operators import audit, series
from lifecurve.operators.detectors import (
    STRICT_JUMPS,
    JumpRule,
    OutlierRule,
    detect_jumps,
    detect_outliers,
)
from lifecurve.operators.ordered import Ordered, arrange
from lifecurve.operators.rollup import primary_candidate, strongest_class

HEADER = [
    "cohort",
    "cycling_consistency",
    "protocol_pattern",
    "n_regimes",
    "max_regime_rate_delta_pct",
    "regime_boundary_cycles",
]
CLASS_RANKS = {"sustained": 3, "transient": 2, "edge_skip": 1, "none": 0}


def document_header(documents: DataFrame) -> DataFrame:
    """Per-cell report columns from the nested documents."""
    regimes = F.coalesce(F.col("regular_rate_regimes"), F.array().cast("array<struct<n_regular_cd:int,baseline_i_a:double>>"))
    rates = F.array_compact(F.transform(regimes, lambda r: r["baseline_i_a"]))
    low, high = F.array_min(rates), F.array_max(rates)
    return documents.select(
        "cell_name",
        cohort_two_way(F.col("cell_name")).alias("cohort"),
        F.coalesce("cycling_consistency", F.lit("no_regular")).alias("cycling_consistency"),
        F.coalesce("protocol_pattern", F.lit("other")).alias("protocol_pattern"),
        F.size(regimes).alias("n_regimes"),
        F.when((F.size(rates) >= 2) & (low > 0), (high - low) / low * 100.0).alias("max_regime_rate_delta_pct"),
        joined_list(series.boundaries_of(F.transform(regimes, lambda r: r["n_regular_cd"]))).alias("regime_boundary_cycles"),
    )


def curve_of(
    cycles: DataFrame, boundaries: DataFrame, entity: str, cycle: str, value: str, tol: int = 2, *, bound: int | None = None
) -> Ordered:
    """Retention against the first row, with the ``near`` flag; entities without a baseline drop out."""
    rows = series.near_boundary(cycles.select(entity, cycle, value), boundaries, entity, cycle, tol=tol)
    o = series.with_retention(arrange(rows, [entity], [cycle], bound=bound), value, cycle)
    return o.where(F.col("retention").isNotNull())


def outlier_report(
    header: DataFrame,
    cycles: DataFrame,
    boundaries: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    value: str = "capacity_discharge_ah",
    rule: OutlierRule = OutlierRule(),
    bound: int | None = None,
) -> DataFrame:
    """One row per outlier, and one row without outlier columns per clean entity."""
    found = detect_outliers(
        curve_of(cycles, boundaries, entity, cycle, value, rule.boundary_skip, bound=bound), cycle, "retention", rule=rule
    )
    last = cycles.groupBy(entity).agg(F.max(cycle).alias("n_regulars"))
    return (
        header.join(last, entity, "left")
        .join(found, entity, "left")
        .fillna(0, ["n_regulars", "n_outliers"])
        .withColumn("near_regime_boundary", F.when(F.col("outlier_cycle").isNotNull(), F.lit(False)))
    )


def step_report(
    header: DataFrame,
    cycles: DataFrame,
    boundaries: DataFrame,
    outliers: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    value: str = "capacity_discharge_ah",
    rule: JumpRule = STRICT_JUMPS,
    skip: Sequence[str] = ("rate_changed",),
    bound: int | None = None,
) -> DataFrame:
    """Sustained steps of entities in scope. Outliers (entity, outlier_cycle; unique) are masked after
    the baseline is taken."""
    scope = header.where(~F.col("cycling_consistency").isin(*skip))
    marks = outliers.where(F.col("outlier_cycle").isNotNull()).select(
        entity, F.col("outlier_cycle").alias(cycle), F.lit(True).alias("_masked")
    )
    inside = cycles.join(scope.select(entity), entity, "left_semi").select(entity, cycle, value)
    rows = inside.join(marks, [entity, cycle], "left")
    o = series.with_retention(arrange(rows, [entity], [cycle], bound=bound), value, cycle)
    o = o.attach(n_outliers_masked=F.count("_masked"))
    o = o.where(F.col("retention").isNotNull() & F.col("_masked").isNull())
    steps = detect_jumps(o, cycle, "retention", rule, keep=["n_outliers_masked"]).where("jump_class = 'sustained'")
    steps = series.near_boundary(
        steps.withColumnRenamed("jump_cycle", cycle), boundaries, entity, cycle
    ).withColumnsRenamed({cycle: "sustained_cycle", "near": "near_regime_boundary"})
    last = cycles.groupBy(entity).agg(F.max(cycle).alias("n_regulars"))
    return (
        steps.join(scope, entity)
        .join(last, entity)
    )


def jump_audit(
    cycles: DataFrame,
    boundaries: DataFrame,
    entities: DataFrame,
    *,
    entity: str = "cell_name",
    cycle: str = "regular_cycle",
    value: str = "capacity_discharge_ah",
    rule: JumpRule = JumpRule(),
    bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, per-entity verdict). The verdict is the strongest class, ``none`` without candidates,
    with the first sustained cycle and whether it lies at a regime boundary."""
    jumps = detect_jumps(curve_of(cycles, boundaries, entity, cycle, value, bound=bound), cycle, "retention", rule)
    best = strongest_class(jumps, entity, "jump_class", CLASS_RANKS)
    first = (
        jumps.where("jump_class = 'sustained'").groupBy(entity).agg(F.min("jump_cycle").alias(cycle))
    )
    first = series.near_boundary(first, boundaries, entity, cycle).withColumnsRenamed(
        {cycle: "first_sustained", "near": "at_boundary"}
    )
    verdict = (
        entities.select(entity)
        .join(best, entity, "left")
        .join(first, entity, "left")
        .fillna("none", ["strongest"])
    )
    return jumps, verdict


def boundary_coincidence(verdict: DataFrame) -> DataFrame:
    """Histogram of verdicts and how many first sustained steps lie at a boundary."""
    return verdict.groupBy("strongest").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("at_boundary").alias("n_at_boundary"),
        F.try_divide(F.count_if("at_boundary"), F.count("at_boundary")).alias("share_at_boundary"),
    )


def review_table(
    steps: DataFrame,
    outliers: DataFrame,
    decisions: DataFrame,
    current: DataFrame,
    *,
    entity: str = "cell_name",
    recorded: str = "n_regular_at_review",
    now: str = "n_regulars",
) -> DataFrame:
    """The review queue with reasons, the primary step, the tail outliers and template values.

    Refuses to run while a decision breaks a rule.
    """
    broken = audit.decision_errors(decisions).where(F.size("errors") > 0).select(entity, "errors").take(5)
    if broken:
        raise ValueError(f"decisions break rules: {[tuple(r) for r in broken]}")
    marks = outliers.where(F.col("outlier_cycle").isNotNull())
    tail = audit.tail_outliers(marks, current, entity, "outlier_cycle", now)
    stale = audit.stale_decisions(decisions, current, entity, recorded, now)
    queue = audit.review_queue(steps, tail, stale, decisions, entity)
    primary = primary_candidate(
        steps.select(entity, "sustained_cycle", "jump_magnitude", "persistence"), entity, "sustained_cycle"
    )
    masked = marks.groupBy(entity).agg(F.count(F.lit(1)).alias("n_outliers_masked"))
    out = (
        queue.join(primary, entity, "left")
        .join(tail.select(entity, "tail_cycles"), entity, "left")
        .join(masked, entity, "left")
        .join(current.select(entity, F.col(now).alias("n_regulars")), entity, "left")
        .fillna(0, ["n_outliers_masked", "n_regulars"])
    )
    template = F.when(
        F.col("needs_template"),
        F.struct(F.lit(False).alias("exclude_from_ml"), F.col("n_regulars").alias("last_available_cycle")),
    )
    return out.withColumn("template", template)
