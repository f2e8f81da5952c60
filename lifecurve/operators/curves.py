"""Curve operators on raw samples: integrals, resampling, derivative, peaks, differences, decay fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.functions.roles import FIT_CYCLES, FIT_FIELDS
from lifecurve.functions.scalars import finite, safe_log_abs, safe_ratio, signed_shift
from lifecurve.operators.ordered import Ordered, arrange, join_on, join_same, largest_group, spread_before_copies
from lifecurve.session import materialize

# Fixed values.
GRID_STEP = 0.005
FINE_STEP = 0.001
PEAK_PROMINENCE = 0.05
PEAK_DISTANCE = 20
MIN_CURVE_POINTS = 10
MAX_TURNS = 1_000_000
MIN_CHARGE = 1e-12
SMOOTH_WINDOW = 51
SMOOTH_ORDER = 3
TAU_FAST = (10.0, 5000.0)
TAU_SLOW = (100.0, 50000.0)
BETA = (0.3, 5.0)
BOUND_GAP = 1e-3


# ---- integrals ------------------------------------------------------------------------------


def with_segments(o: Ordered, t: str, **values: Column) -> Ordered:
    """Step since the previous sample (``dt``) and the trapezoid of each value over it; null on the first row."""
    for name, v in values.items():
        o = o.add(**{f"_v_{name}": v})
    shifted = {f"_p_{n}": (lambda w, n=n: F.lag(f"_v_{n}").over(w)) for n in values}
    o = o.frames(1, 0, _pt=lambda w: F.lag(t).over(w), **shifted)
    o = o.add(dt=F.col(t) - F.col("_pt"))
    return o.add(
        **{n: (F.col(f"_v_{n}") + F.col(f"_p_{n}")) / 2.0 * F.col("dt") for n in values}
    )


def nominal_level(
    df: DataFrame, keys: Sequence[str], t: str, current: str, voltage: str, order: Sequence[str] | None = None,
    *, bound: int | None = None,
) -> DataFrame:
    """Charge-weighted mean voltage |int V I dt| / |int I dt| per slice; null under two samples or no charge."""
    o = arrange(df.select(*keys, *dict.fromkeys([t, current, voltage, *(order or [])])), keys, order or [t], bound=bound)
    o = with_segments(o, t, _energy=F.col(voltage) * F.col(current), _charge=F.col(current))
    sums = o.rows().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("_energy").alias("_e"), F.sum("_charge").alias("_c")
    )
    ok = (F.col("n_samples") >= 2) & (F.abs("_c") >= MIN_CHARGE)
    return sums.select(*keys, "n_samples", F.when(ok, F.abs("_e") / F.abs("_c")).alias("nominal"))


def phase_capacity(
    df: DataFrame, keys: Sequence[str], phase: str, t: str, current: str, order: Sequence[str] | None = None,
    *, charge: str = "charge", discharge: str = "discharge", bound: int | None = None,
) -> DataFrame:
    """Capacity per phase (Ah) side by side, and discharge / charge."""
    at = [*keys, phase]
    rows = df.where(F.col(phase).isin(charge, discharge)).select(*at, *dict.fromkeys([t, current, *(order or [])]))
    o = with_segments(arrange(rows, at, order or [t], bound=bound), t, _q=F.col(current))
    per = o.rows().groupBy(*at).agg((F.abs(F.coalesce(F.sum("_q"), F.lit(0.0))) / 3600.0).alias("_cap"))
    wide = per.groupBy(*keys).agg(
        F.max(F.when(F.col(phase) == charge, F.col("_cap"))).alias("cap_chg_ah"),
        F.max(F.when(F.col(phase) == discharge, F.col("_cap"))).alias("cap_dis_ah"),
    )
    ce = F.when(F.col("cap_chg_ah") > 0, F.col("cap_dis_ah") / F.col("cap_chg_ah"))
    return wide.withColumn("ce", ce)


def cumulative_charge(o: Ordered, t: str, current: str, name: str = "q") -> Ordered:
    """Running charge in Ah, 0 at the first sample."""
    o = with_segments(o, t, _seg=F.col(current))
    return o.add(_seg=F.coalesce(F.col("_seg"), F.lit(0.0)) / 3600.0).running(**{name: F.col("_seg")})


def half_cycle(
    samples: DataFrame, keys: Sequence[str], phase: str, direction: str, t: str, current: str, voltage: str,
    *, bound: int | None = None,
) -> DataFrame:
    """Samples of one direction in time order with their running charge ``q``."""
    rows = samples.where(F.col(phase) == direction).select(*keys, t, current, voltage)
    o = cumulative_charge(arrange(rows, keys, [t], bound=bound), t, current)
    return o.rows().select(*keys, t, voltage, current, "q")


def first_minutes(df: DataFrame, keys: Sequence[str], t: str, minutes: float) -> DataFrame:
    """Samples of the first minutes of each slice."""
    start = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    return join_same(df, start, keys).where(F.col(t) - F.col("_t0") <= minutes * 60.0).drop("_t0")


def tier_b(nominal: DataFrame, window: DataFrame, entity: str, cycle: str, phase: str, *, charge: str = "charge", discharge: str = "discharge") -> DataFrame:
    """Nominal-level retentions over the feature window; all null unless every slice is present.

    ``nominal``: (entity, cycle, phase, nominal). ``window``: the window rows of each entity (at most five).
    """
    wide = nominal.groupBy(entity, cycle).agg(
        F.max(F.when(F.col(phase) == charge, F.col("nominal"))).alias("_chg"),
        F.max(F.when(F.col(phase) == discharge, F.col("nominal"))).alias("_dis"),
    )
    rows = window.select(entity, cycle).join(wide, [entity, cycle], "left")
    agg = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("_chg").isNotNull() & F.col("_dis").isNotNull()).alias("_full"),
        F.min_by("_chg", cycle).alias("_c0"),
        F.min_by("_dis", cycle).alias("_d0"),
        F.max("_dis").alias("_dmax"),
        F.stddev_samp("_dis").alias("_dsd"),
        F.max("_chg").alias("_cmax"),
    )
    ok = (F.col("_n") >= 2) & F.col("_full") & (F.col("_c0") > 0) & (F.col("_d0") > 0)
    return agg.select(
        entity,
        F.when(ok, F.col("_dmax") / F.col("_d0")).alias("discharge_nominal_voltage_retention_max"),
        F.when(ok, F.col("_dsd") / F.col("_d0")).alias("discharge_nominal_voltage_retention_std"),
        F.when(ok, F.col("_cmax") / F.col("_c0")).alias("charge_nominal_voltage_retention_max"),
    )


# ---- grids and interpolation ----------------------------------------------------------------


def common_grid(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, step: float = GRID_STEP) -> DataFrame:
    """(keys, i, x): evenly spaced points over the range both curves cover; no row when they do not overlap."""
    ranges = [
        c.groupBy(*keys).agg(F.min(x).alias(f"_lo_{n}"), F.max(x).alias(f"_hi_{n}")) for c, n in ((a, "a"), (b, "b"))
    ]
    both = join_same(ranges[0], ranges[1], keys).select(
        *keys, F.greatest("_lo_a", "_lo_b").alias("_lo"), F.least("_hi_a", "_hi_b").alias("_hi")
    )
    points = F.ceil((F.col("_hi") + step / 2 - F.col("_lo")) / step)
    return (
        both.where(F.col("_hi") - F.col("_lo") >= step)
        .select(*keys, "_lo", F.explode(F.sequence(F.lit(0).cast("long"), points - 1)).alias("i"))
        .select(*keys, "i", (F.col("_lo") + F.col("i") * step).alias(x))
    )


def own_grid(curve: DataFrame, keys: Sequence[str], x: str, step: float = FINE_STEP) -> DataFrame:
    """Grid over each curve's own range."""
    return common_grid(curve, curve, keys, x, step)


def interpolate(
    curve: DataFrame, grid: DataFrame, keys: Sequence[str], x: str, y: str, *, bound: int | None = None
) -> DataFrame:
    """Linear interpolation at the grid points, flat beyond the ends. Samples at equal x are averaged."""
    samples = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias("_y"))
    none = F.lit(None)
    rows = samples.select(
        *keys, x, F.lit(0).alias("_kind"), none.cast("long").alias("i"), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")).alias("_s")
    ).unionByName(
        grid.select(*keys, x, F.lit(1).alias("_kind"), "i", none.cast("struct<x:double,y:double>").alias("_s"))
    )
    o = arrange(rows, keys, [x, "_kind"], bound=bound)
    o = o.carried("_left", F.col("_s")).carried("_right", F.col("_s"), ahead=True)
    a, b = F.col("_left"), F.col("_right")
    inside = a["y"] + (b["y"] - a["y"]) * F.try_divide(F.col(x) - a["x"], b["x"] - a["x"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == F.col(x)), a["y"]).otherwise(inside)
    return o.rows().where(F.col("_kind") == 1).select(*keys, "i", x, value.alias(y))


def two_curves_on_grid(
    a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, step: float, *, bound: int | None = None
) -> DataFrame:
    """Both curves at the points of their common grid: (keys, i, x, a, b)."""
    grid = common_grid(a, b, keys, x, step)
    left = interpolate(a, grid, keys, x, y, bound=bound).withColumnRenamed(y, "a")
    right = interpolate(b, grid, keys, x, y, bound=bound).select(*keys, "i", F.col(y).alias("b"))
    return join_same(left, right, [*keys, "i"])


def cosine_similarity(
    a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, step: float = GRID_STEP, *, bound: int | None = None
) -> DataFrame:
    """Cosine of the two curves on the common grid; null when one vanishes or fewer than two points are shared."""
    both = two_curves_on_grid(a, b, keys, x, y, step, bound=bound)
    agg = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("a") * F.col("b")).alias("_ab"),
        F.sum(F.col("a") * F.col("a")).alias("_aa"),
        F.sum(F.col("b") * F.col("b")).alias("_bb"),
    )
    ok = (F.col("_n") >= 2) & (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return agg.select(*keys, F.when(ok, F.col("_ab") / (F.sqrt("_aa") * F.sqrt("_bb"))).alias("cosine"))


def delta_q_stats(
    first: DataFrame, last: DataFrame, keys: Sequence[str], x: str, q: str, capacity: DataFrame, step: float = GRID_STEP,
    *, prefix: str = "dqv_norm_c5_c1", bound: int | None = None,
) -> DataFrame:
    """Statistics of (|q_last(x)| - |q_first(x)|) / capacity on the common grid.

    log10 of the population variance (null at 0), min, mean and population skewness.
    ``capacity``: (keys, capacity), positive.
    """
    curves = [c.select(*keys, x, F.abs(q).alias(q)) for c in (last, first)]
    both = two_curves_on_grid(curves[0], curves[1], keys, x, q, step, bound=bound)
    rows = join_same(both, capacity.where(F.col("capacity") > 0), keys).withColumn(
        "_d", (F.col("a") - F.col("b")) / F.col("capacity")
    )
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.var_pop("_d").alias("_v"),
        F.min("_d").alias("_min"),
        F.avg("_d").alias("_mean"),
        F.skewness("_d").alias("_skew"),
    ).where(F.col("_n") >= 2)
    return agg.select(
        *keys,
        F.when(F.col("_v") > 0, F.log10("_v")).alias(f"{prefix}_var_log10"),
        F.col("_min").alias(f"{prefix}_min"),
        F.col("_mean").alias(f"{prefix}_mean"),
        F.when((F.col("_n") >= 3) & (F.col("_v") > 0), finite(F.col("_skew"))).alias(f"{prefix}_skew"),
    )


# ---- smoothed derivative and peaks ----------------------------------------------------------


def derivative_weights(window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER) -> list[float]:
    """Weights of the local-polynomial first derivative per grid step (least squares, published method)."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    return [float(w) for w in np.linalg.pinv(design)[1]]


def smoothed_derivative(
    curve: DataFrame, keys: Sequence[str], x: str, y: str, step: float = FINE_STEP,
    window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER, *, bound: int | None = None,
) -> DataFrame:
    """dy/dx on an even grid: resample, then a fixed weighted sum of ``window`` neighbours.

    Grid points without a full window are dropped.
    """
    even = interpolate(curve, own_grid(curve, keys, x, step), keys, x, y, bound=bound)
    half = window // 2
    weights = F.array(*[F.lit(w / step) for w in derivative_weights(window, order)])
    o = arrange(even, keys, ["i"], bound=bound).frames(
        half, half, _ys=lambda w: F.collect_list(y).over(w.rowsBetween(-half, half))
    )
    o = o.where(F.size("_ys") == window)
    total = F.aggregate(F.zip_with("_ys", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    # The neighbours come in order, so the centre of the window is this row.
    return o.rows().select(*keys, "i", x, total.alias("slope"))


def _pick_peaks(rows: pd.DataFrame, prominence: float, distance: int) -> list[int]:
    """Row numbers of the peaks of one curve given as its runs of equal values, in order."""
    s = rows["_s"].to_numpy(float)
    centre = ((rows["_from"] + rows["_to"]) // 2).to_numpy()
    n = len(s)
    peaks = [i for i in range(1, n - 1) if s[i - 1] < s[i] > s[i + 1]]
    if not peaks:
        return []
    dropped = np.zeros(len(peaks), bool)
    mid = centre[peaks]
    for k in sorted(range(len(peaks)), key=lambda k: (s[peaks[k]], peaks[k]), reverse=True):
        if dropped[k]:
            continue
        for side in (-1, 1):
            j = k + side
            while 0 <= j < len(peaks) and abs(mid[j] - mid[k]) < distance:
                dropped[j] = True
                j += side
    lows = np.maximum(_bases(s), _bases(s[::-1])[::-1])
    floor = prominence * s.max()
    return [i for i, gone in zip(peaks, dropped, strict=True) if not gone and s[i] - lows[i] >= floor]


def _bases(s: np.ndarray) -> np.ndarray:
    """Least value from each place back to the nearest higher one (not included): one pass with a stack."""
    out, open_at = s.copy(), []
    for i, top in enumerate(s):
        while open_at and s[open_at[-1]] <= top:
            out[i] = min(out[i], out[open_at.pop()])
        open_at.append(i)
    return out


def _spaced(peaks: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """Higher peaks first, each kept if none kept before is nearer than ``distance``; of equal ones the later first.

    A peak that leads all open ones near it is kept whatever happens elsewhere, and closes those near it. This is
    repeated on what is still open. Peaks are two samples apart at least, so ``distance`` neighbours reach far enough.
    """
    open_, kept = peaks, None
    while not open_.isEmpty():
        o = arrange(open_, keys, ["_run"])
        size = max(distance, 1)
        point = F.struct("_mid", "_s", "_run")
        o = o.frames(size, size, _near=lambda w: F.collect_list(point).over(w.rowsBetween(-size, size)))
        near = F.filter("_near", lambda p: F.abs(p["_mid"] - F.col("_mid")) < distance)
        first = F.array_max(F.transform(near, lambda p: F.struct(p["_s"], p["_run"])))
        o = o.add(_lead=first == F.struct("_s", "_run")).frames(size, size, _led=lambda w: F.collect_list(F.when(F.col("_lead"), F.col("_mid"))).over(w.rowsBetween(-size, size)))
        found = materialize(o.rows().withColumn("_shut", F.exists("_led", lambda m: F.abs(m - F.col("_mid")) < distance)).drop("_near", "_led"))
        won = found.where("_lead").select(*peaks.columns)
        kept = won if kept is None else kept.unionByName(won)
        open_ = found.where("not _lead and not _shut").select(*peaks.columns)
    return peaks.limit(0) if kept is None else kept


def peaks_in_rounds(turns: DataFrame, keys: Sequence[str], prominence: float, distance: int) -> DataFrame:
    """(keys, _pos, n_peaks) of curves with any number of turning points (keys, _run, _from, _to, _s).

    A peak counts if the curve falls by the floor on both sides before it rises above the peak. Between
    neighbouring peaks only the lowest value matters. A peak whose neighbour is higher behind a shallower dip is out; one
    beside an equal neighbour behind such a dip shares its fate. Both leave the list, the dips around them become
    one, and the rest is asked again: every peak that is still undecided has lost a neighbour, so the rounds are
    about as many as the logarithm of the peaks.
    """
    s, mid = F.col("_s"), F.floor((F.col("_from") + F.col("_to")) / 2).cast("long")
    o = arrange(turns, keys, ["_run"]).frames(1, 1, _l=lambda w: F.lag("_s").over(w), _r=lambda w: F.lead("_s").over(w)).attach(_top=F.max("_s"))
    peaks = o.rows().where((s > F.col("_l")) & (s > F.col("_r")))
    peaks = materialize(peaks.select(*keys, "_run", "_s", F.col("_l"), F.col("_r"), (F.col("_top") * prominence).alias("_floor"), mid.alias("_mid")))
    kept = peaks if distance <= 1 else _spaced(peaks.select(*keys, "_run", "_s", "_mid"), keys, distance)
    mark = kept.select(*keys, "_run", F.col("_mid").alias("_pos"))
    now = join_same(peaks.drop("_mid"), mark, [*keys, "_run"], "left").withColumn("_n", F.col("_pos").isNotNull().cast("long"))
    now, before = materialize(now), -1
    while (left := now.count()) != before:
        before = left
        o = arrange(now, keys, ["_run"]).frames(1, 1, _ls=lambda w: F.lag("_s").over(w), _rs=lambda w: F.lead("_s").over(w))
        flat_l, flat_r = s - F.col("_l") < F.col("_floor"), s - F.col("_r") < F.col("_floor")
        above = lambda c: F.col(c).isNull() | (F.col(c) > s)
        o = o.add(_out=(flat_l & above("_ls")) | (flat_r & above("_rs")))
        o = o.frames(1, 0, _lo=lambda w: F.lag("_out").over(w))
        o = o.add(_same=~F.col("_out") & flat_l & F.coalesce((F.col("_ls") == s) & ~F.col("_lo"), F.lit(False)))
        o = o.add(_head=~F.col("_out") & ~F.col("_same")).running(_g=F.col("_head").cast("long"))
        here = lambda c: F.when(~F.col("_out"), F.col(c))
        of_head = lambda c: F.max(F.when(F.col("_head"), F.col(c))).alias(c)
        groups = o.rows().groupBy(*keys, "_g").agg(
            *[of_head(c) for c in ("_run", "_s", "_l", "_floor")], F.min("_r").alias("_r"), F.min(F.least("_l", "_r")).alias("_any"),
            F.min(here("_pos")).alias("_pos"), F.sum(here("_n")).alias("_n"),
        )
        groups = groups.withColumn("_dip", F.when(F.col("_g") == 0, F.col("_any")).otherwise(F.col("_r")))
        o = arrange(groups, keys, ["_g"]).frames(1, 0, _b=lambda w: F.lag("_dip").over(w))
        o = o.add(_l=F.when(F.col("_g") == 1, F.least("_l", "_b")).otherwise(F.col("_b"))).where(F.col("_g") > 0)
        now = materialize(o.rows().select(*now.columns))
    best = F.min_by("_pos", F.struct(-s, F.col("_pos")))
    found = now.where("_n > 0").groupBy(*keys).agg(best.alias("_pos"), F.sum("_n").alias("n_peaks"))
    return found.select(*keys, "_pos", "n_peaks")


def dominant_peak(
    curve: DataFrame, keys: Sequence[str], x: str, y: str,
    *, prominence: float = PEAK_PROMINENCE, distance: int = PEAK_DISTANCE,
    min_points: int = MIN_CURVE_POINTS, max_turns: int = MAX_TURNS, bound: int | None = None,
) -> DataFrame:
    """Highest peak of |y| per curve: place, signed height and number of peaks.

    Peaks are local maxima at least ``distance`` samples apart (higher ones first) whose prominence
    reaches the given share of the maximum. Spark orders the samples and joins equal neighbours into
    runs; a small helper then walks the turning points of one curve, about 40 bytes each. A curve lives on
    a grid, so they are few; those with more than ``max_turns`` go through rounds of joins of neighbours
    instead (``peaks_in_rounds``), which hold no curve in one task and find the same peaks.
    """
    rows = curve.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.withColumn("_s", F.abs("_y"))
    o = arrange(rows, keys, ["_x"], bound=bound).position("_pos")
    o = o.frames(1, 0, _ps=lambda w: F.lag("_s").over(w)).add(
        _new=F.when(F.col("_ps").isNull() | (F.col("_ps") != F.col("_s")), 1).otherwise(0)
    )
    runs = (
        o.running(_run=F.col("_new"))
        .rows()
        .groupBy(*keys, "_run")
        .agg(F.min("_pos").alias("_from"), F.max("_pos").alias("_to"), F.max("_s").alias("_s"))
    )
    turning = arrange(runs, keys, ["_run"], bound=bound).frames(
        1, 1, _a=lambda w: F.lag("_s").over(w), _b=lambda w: F.lead("_s").over(w)
    )
    s, a, b = F.col("_s"), F.col("_a"), F.col("_b")
    turns = turning.where(a.isNull() | b.isNull() | ((s > a) & (s > b)) | ((s < a) & (s < b))).rows()
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    turns = join_same(turns.drop("_a", "_b"), totals.where(F.col("_n") >= min_points), keys)
    long = None
    if (bound is None or bound > max_turns) and largest_group(turns, keys)[0] > max_turns:
        turns = materialize(turns)
        many = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_turns")).where(F.col("_turns") > max_turns).drop("_turns")
        long = peaks_in_rounds(join_same(turns, many, keys, "left_semi"), keys, prominence, distance)
        turns = join_same(turns, many, keys, "left_anti")
    kinds = dict(turns.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_pos long, n_peaks long"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run").reset_index(drop=True)
        found = _pick_peaks(pdf, prominence, distance)
        heights = pdf["_s"].to_numpy()
        best = [max(found, key=lambda i: (heights[i], -i))] if found else []
        out = pdf.loc[best, [*keys]].copy()
        out["_pos"] = ((pdf["_from"] + pdf["_to"]) // 2).loc[best].astype("int64")
        out["n_peaks"] = pd.Series(len(found), index=out.index, dtype="int64")
        return out

    picked = turns.groupBy(*keys).applyInPandas(walk, schema)
    if long is not None:
        picked = picked.unionByName(long)
    return join_on(o.rows(), picked, [*keys, "_pos"]).select(
        *keys, F.col("_x").alias("peak_x"), F.col("_y").alias("peak_y"), "n_peaks"
    )


def peak_features(peaks: DataFrame, entity: str, cycle: str, direction: str, *, charge: str = "charge", discharge: str = "discharge", first: int = 1, last: int = 5) -> DataFrame:
    """Peak voltage at the last cycle, its shift from the first, and charge - discharge at the last."""

    def at(c, d):
        return F.max(F.when((F.col(cycle) == c) & (F.col(direction) == d), F.col("peak_x")))

    wide = peaks.groupBy(entity).agg(
        at(last, discharge).alias("_l"), at(first, discharge).alias("_f"), at(last, charge).alias("_c")
    )
    return wide.select(
        entity,
        F.col("_l").alias(f"dqdv_peak_v_c{last}_dis"),
        signed_shift(F.col("_f"), F.col("_l")).alias(f"dqdv_peak_v_shift_c{first}c{last}_dis"),
        signed_shift(F.col("_l"), F.col("_c")).alias(f"dqdv_charge_discharge_hysteresis_c{last}"),
    )


def curve_status(curves: DataFrame, entity: str, cycle: str, direction: str, features: DataFrame, wanted: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Which curves an entity has (``has_*``) and how many features came out."""
    flags = curves.groupBy(entity).agg(
        *[F.bool_or((F.col(cycle) == c) & (F.col(direction) == d)).alias(f"has_{name}") for c, d, name in wanted]
    )
    columns = [c for c in features.columns if c != entity]
    ok = F.lit(0)
    for c in columns:
        ok = ok + finite(F.col(c)).isNotNull().cast("int")
    return flags.join(features.select(entity, ok.alias("n_success")), entity, "left").fillna(0, ["n_success"])


def theta_features(peaks: DataFrame, entity: str, cycle: str, direction: str, theta: str, height: str, position: str, *, charge: str = "charge", discharge: str = "discharge", first: int = 1, last: int = 5) -> DataFrame:
    """Angle of the highest peak per cycle and direction (first on ties), and the shifts between cycles."""
    cells = [(c, d, s) for d, s in ((charge, "chg"), (discharge, "dis")) for c in (first, last)]

    def best(c, d):
        here = (F.col(cycle) == c) & (F.col(direction) == d) & F.col(height).isNotNull()
        return F.max_by(F.col(theta), F.when(here, F.struct(F.col(height), -F.col(position))))

    wide = peaks.groupBy(entity).agg(*[best(c, d).alias(f"dop_peak_theta_c{c}_{s}") for c, d, s in cells])
    for s in ("chg", "dis"):
        shift = signed_shift(F.col(f"dop_peak_theta_c{first}_{s}"), F.col(f"dop_peak_theta_c{last}_{s}"))
        wide = wide.withColumn(f"dop_peak_theta_shift_{s}_c{first}c{last}", shift)
    ok = F.lit(0)
    for c in wide.columns[1:]:
        ok = ok + finite(F.col(c)).isNotNull().cast("int")
    return wide.withColumn("n_features_success", ok)


# ---- decay fits -----------------------------------------------------------------------------


def within_bounds(tau_fast: Column, tau_slow: Column, beta: Column, frac: Column) -> Column:
    """Strictly inside the parameter bounds; a fit at a bound is not trusted."""

    def inside(v, limits):
        return (v > limits[0] + BOUND_GAP) & (v < limits[1] - BOUND_GAP)

    return (
        inside(tau_fast, TAU_FAST) & inside(tau_slow, TAU_SLOW) & inside(beta, BETA) & (frac > 0) & (frac < 100)
    )


def _best_decay(samples: DataFrame, keys: Sequence[str], t: str, y: str, fast: Sequence[Column], slow: Column) -> DataFrame:
    """Best (tau_fast, tau_slow, beta) of a grid by least squares in the two amplitudes.

    ``fast``: candidate columns; ``slow``: array column of (tau_slow, beta) structs. The samples are
    repeated once per slow candidate and reduced to sums on the map side, so a group of any size works.
    """
    n_fast = len(fast)
    rows = spread_before_copies(samples, *keys, t).select(*keys, t, y, *[f.alias(f"_tf{i}") for i, f in enumerate(fast)], F.explode(slow).alias("_sl"))
    rows = rows.withColumn("_s", F.exp(-F.pow(F.col(t) / F.col("_sl.tau"), F.col("_sl.beta"))))
    rows = rows.withColumns({f"_f{i}": F.exp(-F.col(t) / F.col(f"_tf{i}")) for i in range(n_fast)})
    yv, s = F.col(y), F.col("_s")
    sums = [
        F.count(F.lit(1)).alias("_n"),
        F.sum(yv).alias("_y"),
        F.sum(yv * yv).alias("_yy"),
        F.sum(s * s).alias("_ss"),
        F.sum(s * yv).alias("_sy"),
    ]
    for i in range(n_fast):
        f = F.col(f"_f{i}")
        sums += [
            F.max(f"_tf{i}").alias(f"_tau{i}"),
            F.sum(f * f).alias(f"_ff{i}"),
            F.sum(f * s).alias(f"_fs{i}"),
            F.sum(f * yv).alias(f"_fy{i}"),
        ]
    agg = rows.groupBy(*keys, "_sl").agg(*sums)
    cells = F.array(
        *[
            F.struct(
                F.col(f"_tau{i}").alias("tf"),
                F.col(f"_ff{i}").alias("ff"),
                F.col(f"_fs{i}").alias("fs"),
                F.col(f"_fy{i}").alias("fy"),
            )
            for i in range(n_fast)
        ]
    )
    each = agg.select(*keys, "_sl", "_n", "_y", "_yy", "_ss", "_sy", F.inline(cells))
    det = F.col("ff") * F.col("_ss") - F.col("fs") * F.col("fs")
    each = each.withColumn("_af", F.try_divide(F.col("fy") * F.col("_ss") - F.col("_sy") * F.col("fs"), det))
    each = each.withColumn("_as", F.try_divide(F.col("_sy") * F.col("ff") - F.col("fy") * F.col("fs"), det))
    each = each.withColumn("_sse", F.col("_yy") - F.col("_af") * F.col("fy") - F.col("_as") * F.col("_sy"))
    each = each.where((F.col("_af") >= 0) & (F.col("_as") >= 0) & (F.col("tf") < F.col("_sl.tau")))
    best = F.min_by(
        F.struct("tf", F.col("_sl.tau").alias("ts"), F.col("_sl.beta").alias("beta"), "_af", "_as", "_sse", "_n", "_y", "_yy"),
        F.struct("_sse", "tf", F.col("_sl.tau"), F.col("_sl.beta")),
    )
    return each.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def spread(limits: tuple[float, float], n: int) -> list[float]:
    """Grid values of even ratio."""
    return [float(v) for v in np.geomspace(*limits, n)]


def decay_fit(
    samples: DataFrame, keys: Sequence[str], t: str, y: str, *, coarse: tuple[int, int, int] = (12, 12, 8), refine: int = 4
) -> DataFrame:
    """Fit y = A_f exp(-t / tau_f) + A_s exp(-(t / tau_s)^beta) per group, with a status.

    Our own numerics: the amplitudes are solved exactly on a grid of (tau_f, tau_s, beta); each
    refinement lays a grid five points wide around the best one, half as far apart as the last. Not bit-equal to other solvers.
    """
    kept = samples.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(t).cast("double").alias(t), F.col(y).cast("double").alias(y)
    )
    nf, ns, nb = coarse
    slow = F.array(
        *[F.struct(F.lit(a).alias("tau"), F.lit(b).alias("beta")) for a in spread(TAU_SLOW, ns) for b in spread(BETA, nb)]
    )
    best = _best_decay(kept, keys, t, y, [F.lit(v) for v in spread(TAU_FAST, nf)], slow)
    ratios = [(TAU_FAST[1] / TAU_FAST[0]) ** (1 / (nf - 1)), (TAU_SLOW[1] / TAU_SLOW[0]) ** (1 / (ns - 1)), (BETA[1] / BETA[0]) ** (1 / (nb - 1))]
    for level in range(1, refine + 1):
        f, s, b = [r ** (0.5**level) for r in ratios]

        def near(col, factor, limits):
            return [F.greatest(F.least(col * m, F.lit(limits[1])), F.lit(limits[0])) for m in (factor**-2, 1 / factor, 1.0, factor, factor**2)]

        around = join_same(kept, best.select(*keys, "tf", "ts", "beta"), keys)
        slow = F.array(
            *[F.struct(x.alias("tau"), z.alias("beta")) for x in near(F.col("ts"), s, TAU_SLOW) for z in near(F.col("beta"), b, BETA)]
        )
        best = _best_decay(around, keys, t, y, near(F.col("tf"), f, TAU_FAST), slow)
    sst = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n")
    groups = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    out = join_same(groups, best, keys, "left")
    frac = F.try_divide(F.col("_af"), F.col("_af") + F.col("_as")) * 100.0
    out = out.select(
        *keys,
        "n_samples",
        F.col("tf").alias("tau_fast"),
        F.col("ts").alias("tau_slow"),
        frac.alias("A_fast_frac"),
        "beta",
        (1 - F.try_divide(F.col("_sse"), sst)).alias("r_squared"),
    )
    ok = F.coalesce(
        within_bounds(F.col("tau_fast"), F.col("tau_slow"), F.col("beta"), F.col("A_fast_frac")), F.lit(False)
    )
    message = F.when(F.col("tau_fast").isNull(), "non-converged").when(~ok, "pinned-to-bound").otherwise("")
    return out.withColumn("success", ok).withColumn("error_msg", message)


def row_mean(cols: Sequence[Column]) -> Column:
    kept = F.array_compact(F.array(*cols))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept))


def row_std_pop(cols: Sequence[Column]) -> Column:
    m = row_mean(cols)
    return F.sqrt(row_mean([(c - m) * (c - m) for c in cols]))


def engineered_ratios(fracs: Sequence[Column]) -> dict[str, Column]:
    """Slow-to-fast ratios of three percentages, missing values skipped."""
    r = [safe_ratio(100.0 - f, f) for f in fracs]
    fs = [finite(f) for f in fracs]
    return {
        "A_slow_to_fast_mean": row_mean(r),
        "A_slow_to_fast_delta": signed_shift(r[0], r[-1]),
        "log_A_slow_to_fast_delta": signed_shift(safe_log_abs(r[0]), safe_log_abs(r[-1])),
        "A_fast_frac_cv": safe_ratio(row_std_pop(fs), F.abs(row_mean(fs))),
    }


def tier_c(fit_rows: DataFrame, entity: str, cycle: str, cycles: Sequence[int] = FIT_CYCLES) -> DataFrame:
    """Fit values per cycle, their mean, population std and end difference, and the ratio columns.

    Failed fits are missing; mean and std skip them, the difference needs both ends.
    """
    ok = fit_rows.withColumn("tau_ratio", F.when(F.col("tau_fast") > 0, F.col("tau_slow") / F.col("tau_fast")))
    wide = ok.groupBy(entity).agg(
        *[
            F.max(F.when(F.col("success") & (F.col(cycle) == c), F.col(f))).alias(f"cv_{f}_c{c}")
            for f in FIT_FIELDS
            for c in cycles
        ]
    )
    for f in FIT_FIELDS:
        cols = [F.col(f"cv_{f}_c{c}") for c in cycles]
        wide = wide.withColumns(
            {
                f"cv_{f}_mean": row_mean(cols),
                f"cv_{f}_std": row_std_pop(cols),
                f"cv_{f}_delta": signed_shift(cols[0], cols[-1]),
            }
        )
    return wide.withColumns(engineered_ratios([F.col(f"cv_A_fast_frac_c{c}") for c in cycles]))


def skip_missing_rollup(df: DataFrame, entity: str, cycle: str, value: str, cycles: Sequence[int]) -> DataFrame:
    """Mean, population std and end difference of a value over listed ordinals, NaN and null skipped."""
    v = finite(F.col(value))
    here = F.col(cycle).isin(list(cycles))

    def at(c):
        return F.max(F.when(F.col(cycle) == c, v))

    return df.groupBy(entity).agg(
        F.avg(F.when(here, v)).alias("mean"),
        F.stddev_pop(F.when(here, v)).alias("std"),
        (at(cycles[-1]) - at(cycles[0])).alias("delta"),
    )


def success_distribution(status: DataFrame, entity: str, flag: str = "success") -> DataFrame:
    """How many entities have 0, 1, 2, ... successes."""
    per = status.groupBy(entity).agg(F.count_if(F.col(flag)).alias("n_success"))
    return per.groupBy("n_success").agg(F.count(F.lit(1)).alias("n_entities"))
