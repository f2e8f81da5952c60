"""End-to-end builds from documents and samples to label and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifecurve.functions import roles
from lifecurve.operators import curves, labels
from lifecurve.session import materialize
from lifecurve.sources import readers


def label_table(
    spark: SparkSession,
    documents: str,
    decisions: str,
    outliers: str,
    *,
    baseline_cycle: int = 1,
    horizons: Sequence[int] = labels.HORIZONS,
    lines: bool = False,
) -> DataFrame:
    """Documents, decisions and outlier marks -> the label table with its complete column list.

    ``lines``: all three hold one JSON object per cell and line.
    """
    good, _ = readers.read_documents(spark, documents, lines=lines)
    marks = readers.read_outliers(spark, outliers, lines=lines).select("cell_name", F.col("cycle").cast("int").alias("regular_cycle"))
    out = labels.build_labels(
        readers.cell_header(good),
        readers.flatten_cycles(good),
        decisions=readers.read_decisions(spark, decisions, lines=lines),
        outliers=marks,
        baseline_cycle=baseline_cycle,
        horizons=horizons,
    )
    return roles.check_columns(out, roles.label_columns(horizons))


def feature_tables(
    cells: DataFrame,
    cycles: DataFrame,
    samples: DataFrame,
    plateau: DataFrame,
    *,
    baseline_cycle: int = 1,
    bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(features, fit status) of eligible cells.

    ``samples``: cell_name, cd_index, cd_phase, elapsed_time, current, voltage.
    ``plateau``: cell_name, cd_index, t_s, current - the constant-voltage part, cut upstream.
    Samples are read for eligible cells only (semi join).
    """
    window = materialize(labels.feature_window(cells, cycles, baseline_cycle=baseline_cycle, bound=bound))
    spine = window.select("cell_name").distinct()
    tier_a = labels.tier_a(window)

    slices = window.select("cell_name", "regular_cycle", "cd_index")
    raw = samples.join(spine, "cell_name", "left_semi")
    nominal = curves.nominal_level(
        raw.join(slices, ["cell_name", "cd_index"]),
        ["cell_name", "regular_cycle", "cd_phase"],
        "elapsed_time",
        "current",
        "voltage",
        bound=bound,
    )
    tier_b = curves.tier_b(nominal, window, "cell_name", "regular_cycle", "cd_phase")

    wanted = cycles.join(spine, "cell_name", "left_semi").where(F.col("regular_cycle").isin(roles.FIT_CYCLES)).select(
        "cell_name", "regular_cycle", "cd_index"
    )
    milliamps = plateau.withColumn("_i", F.col("current") * 1000.0).join(wanted, ["cell_name", "cd_index"])
    fits = curves.decay_fit(milliamps, ["cell_name", "regular_cycle", "cd_index"], "t_s", "_i")
    status = wanted.join(fits, ["cell_name", "regular_cycle", "cd_index"], "left").select(
        "cell_name",
        "regular_cycle",
        "cd_index",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("error_msg", F.lit("no samples")).alias("error_msg"),
        "tau_fast",
        "tau_slow",
        "A_fast_frac",
        "beta",
        "r_squared",
    )
    tier_c = curves.tier_c(status, "cell_name", "regular_cycle")
    out = spine
    for block in (tier_a, tier_b, tier_c):
        out = out.join(block, "cell_name", "left")
    return roles.check_columns(out, ["cell_name", *roles.FEATURES]), status


def candidate_features(
    samples: DataFrame, slices: DataFrame, *, first: int = 1, last: int = 5, bound: int | None = None
) -> DataFrame:
    """dQ/dV peak and shape features and the charge-difference statistics per cell.

    ``samples``: cell_name, cd_index, cd_phase, step_time, current, voltage with any plateau already cut.
    ``slices``: cell_name, regular_cycle, cd_index.
    """
    keys = ["cell_name", "regular_cycle"]
    used = samples.join(slices.where(F.col("regular_cycle").isin(first, last)), ["cell_name", "cd_index"])
    # Both are read several times below: written once, so nothing upstream runs twice.
    halves = {
        d: materialize(curves.half_cycle(used, keys, "cd_phase", d, "step_time", "current", "voltage", bound=bound))
        for d in ("charge", "discharge")
    }
    slopes = {
        d: materialize(curves.smoothed_derivative(h, keys, "voltage", "q", bound=bound)) for d, h in halves.items()
    }
    peaks = None
    for d, s in slopes.items():
        part = curves.dominant_peak(s, keys, "voltage", "slope", bound=bound).withColumn("cd_phase", F.lit(d))
        peaks = part if peaks is None else peaks.unionByName(part)
    peak = curves.peak_features(peaks, "cell_name", "regular_cycle", "cd_phase", first=first, last=last)

    def one(df, cycle):
        return df.where(F.col("regular_cycle") == cycle).drop("regular_cycle")

    dis, slope = halves["discharge"], slopes["discharge"]
    cosine = curves.cosine_similarity(
        one(slope, first), one(slope, last), ["cell_name"], "voltage", "slope", bound=bound
    ).withColumnRenamed("cosine", f"dqdv_cosine_sim_c{first}c{last}_dis")
    capacity = one(dis, first).groupBy("cell_name").agg(
        F.abs(F.max_by("q", "step_time") - F.min_by("q", "step_time")).alias("capacity")
    )
    stats = curves.delta_q_stats(
        one(dis, first), one(dis, last), ["cell_name"], "voltage", "q", capacity, prefix=f"dqv_norm_c{last}_c{first}", bound=bound
    )
    out = slices.select("cell_name").distinct()
    for block in (peak, cosine, stats):
        out = out.join(block, "cell_name", "left")
    return out
