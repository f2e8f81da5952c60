"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cohort names and name prefixes the results must carry.
TWO_WAY_COHORTS = (("0MC", "0MC"),)
TWO_WAY_DEFAULT = "AR"
THREE_WAY_COHORTS = (("AR", "AR"), ("0MC2", "0MC2"))
THREE_WAY_DEFAULT = "other"

# Limits of the ratio and Box-Cox helpers.
RATIO_EPS = 0.5
BOXCOX_ZERO = 1e-12
BOXCOX_FLOOR = 1e-12
EXP_LIMIT = 50.0


def prefix_cohort(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First matching prefix names the cohort."""
    out = F.lit(default)
    for prefix, label in reversed(list(rules)):
        out = F.when(name.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def cohort_two_way(name: Column) -> Column:
    return prefix_cohort(name, TWO_WAY_COHORTS, TWO_WAY_DEFAULT)


def cohort_three_way(name: Column) -> Column:
    return prefix_cohort(name, THREE_WAY_COHORTS, THREE_WAY_DEFAULT)


def finite(x: Column) -> Column:
    """Null for NaN and infinities: one missing value inside Spark."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_ratio(num: Column, den: Column, eps: float = RATIO_EPS) -> Column:
    num, den = finite(num), finite(den)
    return F.when(F.abs(den) >= eps, F.try_divide(num, den))


def safe_log_abs(x: Column) -> Column:
    x = finite(x)
    return F.when(x != 0, F.log(F.abs(x)))


def signed_shift(start: Column, end: Column) -> Column:
    """end - start, null when either is missing."""
    return finite(end) - finite(start)


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(finite(a) - finite(b))


def same_value(a: Column, b: Column) -> Column:
    """Equality in which two missing values are equal."""
    return finite(a).eqNullSafe(finite(b))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[finite(c) for c in cols])


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def risk_positive(score: Column, orientation: str) -> Column:
    """Higher = sooner failure, whatever the model predicts."""
    if orientation not in ("risk_high", "time_high"):
        raise ValueError(f"unknown orientation {orientation!r}")
    return -score if orientation == "time_high" else score


def joined_list(items: Column, sep: str = ",") -> Column:
    """Array as text; null when empty."""
    return F.when(F.size(items) > 0, F.array_join(items.cast("array<string>"), sep))


def dominant(items: Column, weight: str, value: str) -> Column:
    """``value`` of the struct with the largest ``weight``; the first one on ties."""
    best = F.aggregate(
        items,
        items[0],
        lambda acc, x: F.when(x[weight] > acc[weight], x).otherwise(acc),
    )
    return F.when(F.size(items) > 0, best[value])


def transform_target(y: Column, kind: str, lam: Column | float | None = None) -> Column:
    """Target on the training scale."""
    if kind == "none":
        return y.cast("double")
    if kind == "log":
        return F.log(y)
    if kind == "sqrt":
        return F.sqrt(y)
    if kind == "boxcox":
        lam = lam if isinstance(lam, Column) else F.lit(float(lam))
        return F.when(F.abs(lam) < BOXCOX_ZERO, F.log(y)).otherwise(
            F.try_divide(F.pow(y, lam) - 1.0, lam)
        )
    raise ValueError(f"unknown transform {kind!r}")


def inverse_target(z: Column, kind: str, lam: Column | float | None = None) -> Column:
    """Back to the original scale; the Box-Cox base is kept positive."""
    if kind == "none":
        return z.cast("double")
    if kind == "log":
        return F.exp(z)
    if kind == "sqrt":
        return z * z
    if kind == "boxcox":
        lam = lam if isinstance(lam, Column) else F.lit(float(lam))
        base = F.greatest(lam * z + 1.0, F.lit(BOXCOX_FLOOR))
        return F.when(F.abs(lam) < BOXCOX_ZERO, F.exp(clip(z, -EXP_LIMIT, EXP_LIMIT))).otherwise(
            F.pow(base, F.try_divide(F.lit(1.0), lam))
        )
    raise ValueError(f"unknown transform {kind!r}")
