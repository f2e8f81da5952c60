"""Step (jump) and isolated-outlier detection on retention series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.ordered import Ordered, join_same
from lifecurve.operators.ranks import attach_quantile, exact_quantiles


@dataclass(frozen=True)
class JumpRule:
    """Fixed values of the jump detector."""

    bump_min: float = 0.03
    pre_window: int = 20
    post_window: int = 10
    persist_min: float = 0.03
    min_pre: int = 10
    min_post: int = 5


STRICT_JUMPS = JumpRule(bump_min=0.05, persist_min=0.05)


@dataclass(frozen=True)
class OutlierRule:
    """Fixed values of the outlier detector. A side keeps ``half - trim`` of its ``half`` neighbours."""

    half: int = 5
    trim: int = 2
    min_side: int = 3
    boundary_skip: int = 2
    discontinuity_max: float = 0.03
    mad_multiplier: float = 4.0
    mad_factor: float = 1.4826
    sigma_floor: float = 0.005
    skip_last: int = 0

    def __post_init__(self):
        if self.half != self.min_side + self.trim:
            raise ValueError("a side is usable only when all its neighbours are: half = min_side + trim")


def rolling_trend(o: Ordered, cycle: str, value: str, back: int = 20) -> Ordered:
    """OLS line through the previous ``back`` rows: slope, intercept and points used.

    With one point, or one distinct ordinal, the line is flat through the mean.
    """

    def frame(w):
        return w.rowsBetween(-back, -1)

    o = o.frames(
        back,
        0,
        _slope=lambda w: F.regr_slope(F.col(value), F.col(cycle)).over(frame(w)),
        _icpt=lambda w: F.regr_intercept(F.col(value), F.col(cycle)).over(frame(w)),
        _mean=lambda w: F.avg(F.col(value)).over(frame(w)),
        pre_n=lambda w: F.count(F.col(value)).over(frame(w)),
    )
    flat = (F.col("pre_n") < 2) | F.col("_slope").isNull()
    return o.add(
        pre_slope=F.when(flat, F.lit(0.0)).otherwise(F.col("_slope")),
        pre_intercept=F.when(flat, F.col("_mean")).otherwise(F.col("_icpt")),
    )


def _median_of(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    odd = F.get(s, F.floor(n / 2).cast("int"))
    even = (F.get(s, (F.floor(n / 2) - 1).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n % 2 == 1, odd).otherwise(even)


def detect_jumps(
    o: Ordered, cycle: str, retention: str, rule: JumpRule = JumpRule(), keep: Sequence[str] = ()
) -> DataFrame:
    """One row per candidate: step size, pre-trend, persistence and class (and the kept columns)."""
    r, c = F.col(retention), F.col(cycle)
    framed = o.frames(
        rule.pre_window,
        rule.post_window - 1,
        _prev=lambda w: F.lag(r).over(w),
        _slope=lambda w: F.regr_slope(r, c).over(w.rowsBetween(-rule.pre_window, -1)),
        _intercept=lambda w: F.regr_intercept(r, c).over(w.rowsBetween(-rule.pre_window, -1)),
        pre_n=lambda w: F.count(r).over(w.rowsBetween(-rule.pre_window, -1)),
        _post=lambda w: F.collect_list(F.struct(c.alias("x"), r.alias("y"))).over(
            w.rowsBetween(0, rule.post_window - 1)
        ),
    ).rows()
    candidates = framed.withColumn("jump_magnitude", r - F.col("_prev")).where(
        F.abs(F.col("jump_magnitude")) >= rule.bump_min
    )
    edge = (F.col("pre_n") < rule.min_pre) | (F.col("post_n") < rule.min_post)
    residuals = F.transform(
        F.col("_post"), lambda p: p["y"] - (F.col("_slope") * p["x"] + F.col("_intercept"))
    )
    zero = F.lit(0.0)
    return (
        candidates.withColumn("post_n", F.size("_post").cast("long"))
        .withColumn("_persist", _median_of(residuals))
        .select(
            *o.keys,
            c.alias("jump_cycle"),
            "jump_magnitude",
            F.when(F.col("jump_magnitude") > 0, "up").otherwise("down").alias("jump_direction"),
            F.when(edge, zero).otherwise(F.col("_slope")).alias("pre_slope"),
            F.when(edge, zero).otherwise(F.col("_intercept")).alias("pre_intercept"),
            "pre_n",
            "post_n",
            F.when(edge, zero).otherwise(F.col("_persist")).alias("persistence"),
            F.when(edge, "edge_skip")
            .when(F.abs(F.col("_persist")) >= rule.persist_min, "sustained")
            .otherwise("transient")
            .alias("jump_class"),
            *keep,
        )
    )


def _trimmed_line(df: DataFrame, points: Sequence[str], keep: int, name: str) -> DataFrame:
    """Least-trimmed-squares value at the own row, from neighbours given as (dx, dy) structs.

    Offsets are relative to the own row, so the prediction is the intercept. Every ``keep``-subset is
    fitted from sums, with plain arithmetic that stays in small generated code. The smallest own
    residual wins; on ties the earliest subset.
    """
    subsets = list(combinations(range(len(points)), keep))
    base = [c for c in df.columns if c not in points]
    known = " AND ".join(f"{p} IS NOT NULL" for p in points)
    offsets = [f"coalesce({p}.d{a}, 0.0D) AS {p}{a}" for p in points for a in "xy"]
    products = [f"{p}{a} * {p}{b} AS {p}{a}{b}" for p in points for a, b in ("xx", "xy", "yy")]
    sums, dens, slopes, misses, picks = [], [], [], [], []
    for k, subset in enumerate(subsets):
        for part in ("x", "y", "xx", "xy", "yy"):
            sums.append(" + ".join(f"{points[i]}{part}" for i in subset) + f" AS _s{k}{part}")
        dens.append(f"{keep}.0D * _s{k}xx - _s{k}x * _s{k}x AS _d{k}")
        dens.append(f"{keep}.0D * _s{k}xy - _s{k}x * _s{k}y AS _n{k}")
        slopes.append(f"if(_d{k} = 0.0D, 0.0D, _n{k} / _d{k}) AS _m{k}")
        misses.append(f"{keep}.0D * _s{k}yy - _s{k}y * _s{k}y - _m{k} * _n{k} AS _e{k}")
        picks.append(f"WHEN _e{k} = _least THEN (_s{k}y - _m{k} * _s{k}x) / {keep}.0D")
    least = f"least({', '.join(f'_e{k}' for k in range(len(subsets)))})" if len(subsets) > 1 else "_e0"
    return (
        df.selectExpr(*base, f"{known} AS _known", *offsets)
        .selectExpr("*", *products)
        .selectExpr(*base, "_known", *sums)
        .selectExpr("*", *dens)
        .selectExpr("*", *slopes)
        .selectExpr("*", *misses)
        .selectExpr("*", f"CASE WHEN _known THEN {least} END AS _least")
        .selectExpr(*base, f"CASE {' '.join(picks)} END AS {name}")
    )


def side_predictions(
    o: Ordered, cycle: str, value: str, near: str, rule: OutlierRule = OutlierRule()
) -> Ordered:
    """LTS predictions from the ``half`` rows before and after; null when a side is not usable."""
    c, v = F.col(cycle), F.col(value)
    o = o.add(_pt=F.when(~F.col(near) & v.isNotNull(), F.struct(c.cast("double").alias("x"), v.alias("y"))))

    def reader(step, k):
        def offset(w):
            p = (F.lag("_pt", k) if step < 0 else F.lead("_pt", k)).over(w)
            return F.when(
                p.isNotNull(), F.struct((p["x"] - c).alias("dx"), (p["y"] - v).alias("dy"))
            )

        return offset

    for side, step in (("pre", -1), ("post", 1)):
        ks = range(rule.half, 0, -1) if step < 0 else range(1, rule.half + 1)
        points = {f"_p{i}": reader(step, k) for i, k in enumerate(ks)}
        o = o.frames(rule.half if step < 0 else 0, 0 if step < 0 else rule.half, **points)
        fitted = _trimmed_line(o.df, list(points), rule.half - rule.trim, "_at")
        fitted = fitted.withColumn(f"predict_{side}", v + F.col("_at")).drop("_at")
        o = replace(o, df=fitted)
    # One generated row per row: later filters on the predictions stay above this point instead of
    # being pushed down, which would repeat the whole fit inside the filter expression.
    both = ["predict_pre", "predict_post"]
    kept = [col for col in o.df.columns if col not in ("_pt", *both)]
    return replace(o, df=o.df.select(*kept, F.inline(F.array(F.struct(*both)))))


def tested_residuals(
    o: Ordered, cycle: str, retention: str, near: str = "near", rule: OutlierRule = OutlierRule()
) -> Ordered:
    """Rows the outlier rule tests, with prediction and residual."""
    o = side_predictions(o, cycle, retention, near, rule)
    if rule.skip_last:
        o = o.frames(0, rule.skip_last, _ahead=lambda w: F.lead(cycle, rule.skip_last).over(w))
        o = o.where(F.col("_ahead").isNotNull())
    keep = rule.half - rule.trim
    o = o.where(~F.col(near) & F.col("predict_pre").isNotNull()).add(
        pre_post_gap=F.abs(F.col("predict_pre") - F.col("predict_post")),
        predicted=F.coalesce((F.col("predict_pre") + F.col("predict_post")) * 0.5, F.col("predict_pre")),
        residual=F.col(retention) - F.col("predicted"),
        pre_n=F.lit(keep).cast("long"),
        post_n=F.when(F.col("predict_post").isNull(), 0).otherwise(keep).cast("long"),
    )
    return o.where(F.col("pre_post_gap").isNull() | (F.col("pre_post_gap") <= rule.discontinuity_max))


def mad_scale(
    df: DataFrame, keys: Sequence[str], value: str, *, factor: float = 1.4826, floor: float = 0.005,
    bound: int | None = None,
) -> DataFrame:
    """Median, median absolute deviation and floored sigma per key (exact medians)."""
    med = exact_quantiles(df, keys, value, {"med": 0.5}, bound=bound)
    spread = join_same(df, med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = exact_quantiles(spread, keys, "_dev", {"mad": 0.5}, bound=bound)
    return join_same(med, mad, keys).select(
        *keys, "med", "mad", F.greatest(F.col("mad") * factor, F.lit(floor)).alias("sigma")
    )


def detect_outliers(
    o: Ordered,
    cycle: str,
    retention: str,
    near: str = "near",
    rule: OutlierRule = OutlierRule(),
) -> DataFrame:
    """One row per isolated outlier: prediction, residual, robust z-score and the entity's outlier count."""
    o = tested_residuals(o, cycle, retention, near, rule)
    o = attach_quantile(o, "_med", "residual", 0.5).add(_dev=F.abs(F.col("residual") - F.col("_med")))
    o = attach_quantile(o, "_mad", "_dev", 0.5)
    sigma = F.greatest(F.col("_mad") * rule.mad_factor, F.lit(rule.sigma_floor))
    o = o.add(_sigma=sigma, z_score=(F.col("residual") - F.col("_med")) / F.col("_sigma"))
    o = o.where(F.abs(F.col("residual") - F.col("_med")) > rule.mad_multiplier * F.col("_sigma"))
    o = o.attach(n_outliers=F.count(F.lit(1)))
    return o.rows().select(
        *o.keys,
        F.col(cycle).alias("outlier_cycle"),
        F.col(retention).alias("retention"),
        "predicted",
        "residual",
        "z_score",
        "pre_post_gap",
        "pre_n",
        "post_n",
        "n_outliers",
    )
