"""Operators on (entity, ordinal, value) series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.operators.ordered import Ordered, arrange, join_on, join_per_key

# Fixed values of the fade rule.
FADE_THRESHOLD = 0.85
RECOVERY_MIN = 3


def number_cycles(
    df: DataFrame, entity: str, order: Sequence[str], cycle: str = "cycle", *, bound: int | None = None
) -> Ordered:
    """1-based ordinal of every row of an entity."""
    return arrange(df, [entity], order, bound=bound).position(cycle)


def nth_event(
    df: DataFrame, entity: str, order: Sequence[str], n: int, *, bound: int | None = None
) -> DataFrame:
    """The n-th row (1-based) of each entity."""
    o = arrange(df, [entity], order, bound=bound).position("_nth")
    return o.where(F.col("_nth") == n).rows().drop("_nth")


def with_retention(
    o: Ordered, value: str, cycle: str, *, baseline_cycle: int | None = None, name: str = "retention"
) -> Ordered:
    """value / baseline. The baseline row is ordinal ``baseline_cycle``, or the first row when None.

    A missing or non-positive baseline gives null.
    """
    if baseline_cycle is None:
        base = F.min_by(F.col(value), F.col(cycle))
    else:
        base = F.max(F.when(F.col(cycle) == baseline_cycle, F.col(value)))
    o = o.attach(baseline=base)
    return o.add(**{name: F.when(F.col("baseline") > 0, F.try_divide(F.col(value), F.col("baseline")))})


def with_crossings(
    o: Ordered, retention: str = "retention", threshold: float = FADE_THRESHOLD
) -> Ordered:
    """``crossing``: below now and not below on the previous row (or no previous row)."""
    prev = {"_prev": lambda w: F.lag(retention).over(w)}
    return o.frames(1, 0, **prev).add(
        crossing=(F.col(retention) < threshold)
        & (F.col("_prev").isNull() | (F.col("_prev") >= threshold))
    )


def with_later_healthy(
    o: Ordered, retention: str = "retention", threshold: float = FADE_THRESHOLD
) -> Ordered:
    """``healthy_after``: number of later rows strictly above the threshold."""
    healthy = F.when(F.col(retention) > threshold, 1).otherwise(0).cast("long")
    o = o.add(_healthy=healthy).running(_upto=F.col("_healthy")).attach(_all_healthy=F.sum("_healthy"))
    return o.add(healthy_after=F.col("_all_healthy") - F.col("_upto"))


def fade_rows(
    o: Ordered,
    retention: str = "retention",
    threshold: float = FADE_THRESHOLD,
    recovery_min: int = RECOVERY_MIN,
) -> DataFrame:
    """Rows with ``crossing`` and ``sticky`` (a crossing that never recovers)."""
    o = with_later_healthy(with_crossings(o, retention, threshold), retention, threshold)
    o = o.add(sticky=F.col("crossing") & (F.col("healthy_after") < recovery_min))
    return o.rows()


def sticky_fade(
    o: Ordered,
    entity: str,
    cycle: str = "cycle",
    retention: str = "retention",
    threshold: float = FADE_THRESHOLD,
    recovery_min: int = RECOVERY_MIN,
) -> DataFrame:
    """Per entity: last sticky crossing, recovered crossings, observations and final value."""
    rows = fade_rows(o, retention, threshold, recovery_min)
    return rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max(cycle).alias("last_cycle"),
        F.max(F.when(F.col("sticky"), F.col(cycle))).alias("last_fade"),
        F.count_if(F.col("crossing") & ~F.col("sticky")).alias("n_recovered"),
        F.max_by(retention, cycle).alias("final_retention"),
    )


def value_at_or_before(cycle: Column, value: Column, target: Column | int) -> Column:
    """Aggregate: value at the largest ordinal <= target."""
    return F.max_by(value, F.when(cycle <= target, cycle))


def value_at_or_after(cycle: Column, value: Column, target: Column | int) -> Column:
    """Aggregate: value at the first ordinal >= target."""
    return F.min_by(value, F.when(cycle >= target, cycle))


def asof_backward(
    df: DataFrame, targets: DataFrame, entity: str, cycle: str, value: str, target: str,
    *, bound: int | None = None,
) -> DataFrame:
    """Per target row: value and ordinal of the latest row at or before the target ordinal.

    ``targets`` is unique on the entity. The match is one grouped aggregate, so a hot entity is
    combined on the map side.
    """
    hit = F.col(cycle) <= F.col(target)
    found = (
        join_per_key(df.select(entity, cycle, value), targets.select(entity, target), [entity], bound=bound)
        .where(hit)
        .groupBy(entity)
        .agg(F.max_by(value, cycle).alias("value_at"), F.max(cycle).alias("cycle_at"))
    )
    return join_on(targets, found, [entity], "left")


def asof_forward(df: DataFrame, entity: str, cycle: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """Per entity and horizon N: value and ordinal of the first row with ordinal >= N (null if none)."""
    aggs = []
    for n in horizons:
        reached = F.when(F.col(cycle) >= n, F.col(cycle))
        aggs += [
            F.min_by(value, reached).alias(f"value_at_n{n}"),
            F.min(reached).alias(f"cycle_at_n{n}"),
        ]
    return df.groupBy(entity).agg(*aggs)


def running_min_to(
    df: DataFrame, entity: str, cycle: str, value: str, horizons: Sequence[int], *, bound: int | None = None
) -> DataFrame:
    """Smallest value through the first ordinal >= N, or over the whole series if N is not reached."""
    stops = df.groupBy(entity).agg(
        *[F.min(F.when(F.col(cycle) >= n, F.col(cycle))).alias(f"_stop{n}") for n in horizons]
    )
    joined = join_per_key(df.select(entity, cycle, value), stops, [entity], bound=bound)
    return joined.groupBy(entity).agg(
        *[
            F.min(
                F.when(F.col(f"_stop{n}").isNull() | (F.col(cycle) <= F.col(f"_stop{n}")), F.col(value))
            ).alias(f"min_through_n{n}")
            for n in horizons
        ]
    )


def retention_family(
    df: DataFrame,
    entity: str,
    cycle: str,
    value: str,
    horizons: Sequence[int],
    snapshot: DataFrame | None = None,
    snapshot_cycle: str = "snapshot_cycle",
    at: int = 5,
    *,
    bound: int | None = None,
) -> DataFrame:
    """All retention definitions of an entity in one aggregate: at an ordinal, last, min, first >= N
    and at an optional per-entity snapshot ordinal. Entities with a zero first value are dropped."""
    c, v = F.col(cycle), F.col(value)
    if snapshot is not None:
        rows = df.select(entity, cycle, value)
        df = join_per_key(rows, snapshot.select(entity, snapshot_cycle), [entity], "left", bound=bound)
    aggs = [
        F.max(c).alias("n_cycles"),
        F.min_by(v, c).alias("first_value"),
        F.max(F.when(c == at, v)).alias(f"v_c{at}"),
        F.max_by(v, c).alias("v_last"),
        F.min(v).alias("v_min"),
    ]
    aggs += [value_at_or_after(c, v, n).alias(f"v_n{n}") for n in horizons]
    if snapshot is not None:
        aggs.append(value_at_or_before(c, v, F.col(snapshot_cycle)).alias("v_snapshot"))
    wide = df.groupBy(entity).agg(*aggs).where(F.col("first_value") != 0)
    parts = [f"c{at}", "last", "min", *[f"n{n}" for n in horizons]]
    if snapshot is not None:
        parts.append("snapshot")
    return wide.select(
        entity,
        "n_cycles",
        "first_value",
        *[F.try_divide(F.col(f"v_{p}"), F.col("first_value")).alias(f"ret_{p}") for p in parts],
    )


def regime_boundaries(
    regimes: DataFrame, entity: str, pos: str, length: str, *, bound: int | None = None
) -> DataFrame:
    """Cumulative regime lengths per entity; the last regime gives no boundary, null lengths add none."""
    o = arrange(regimes, [entity], [pos], bound=bound)
    o = o.running(boundary=F.coalesce(F.col(length), F.lit(0)).cast("long"))
    o = o.attach(_last=F.max(pos))
    return (
        o.rows()
        .where((F.col(pos) < F.col("_last")) & F.col(length).isNotNull())
        .select(entity, pos, "boundary")
    )


def near_boundary(
    df: DataFrame, boundaries: DataFrame, entity: str, cycle: str, boundary: str = "boundary", tol: int = 2
) -> DataFrame:
    """``near``: ordinal within +-tol of a boundary of its entity.

    Each boundary becomes the 2*tol+1 integer ordinals it covers, so the interval test is an equi
    join on (entity, ordinal) and no boundary list is collected.
    """
    covered = boundaries.select(
        entity, F.explode(F.sequence(F.col(boundary) - tol, F.col(boundary) + tol)).alias(cycle)
    ).distinct()
    return join_on(df, covered.withColumn("_hit", F.lit(True)), [entity, cycle], "left").select(
        *df.columns, F.coalesce("_hit", F.lit(False)).alias("near")
    )


def rate_delta_pct(regimes: DataFrame, entity: str, rate: str) -> DataFrame:
    """(max - min) / min * 100 over the regimes; null with fewer than two rates or a minimum <= 0."""
    agg = regimes.groupBy(entity).agg(
        F.count(rate).alias("_n"), F.min(rate).alias("_lo"), F.max(rate).alias("_hi")
    )
    return agg.select(
        entity,
        F.when(
            (F.col("_n") >= 2) & (F.col("_lo") > 0), (F.col("_hi") - F.col("_lo")) / F.col("_lo") * 100.0
        ).alias("max_rate_delta_pct"),
    )


def value_at_ordinals(df: DataFrame, entity: str, cycle: str, values: Mapping[str, str], at: Sequence[int]) -> DataFrame:
    """Wide row per entity: each value at each listed ordinal, named ``{prefix}_c{n}``."""
    return df.groupBy(entity).agg(
        *[
            F.max(F.when(F.col(cycle) == n, F.col(v))).alias(f"{prefix}_c{n}")
            for n in at
            for prefix, v in values.items()
        ]
    )


def boundaries_of(lengths: Column) -> Column:
    """Boundaries from the array of regime lengths of one document; the last regime gives none."""
    inner = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")
    )

    def step(acc, n):
        at = acc["at"] + F.coalesce(n.cast("long"), F.lit(0))
        return F.struct(
            at.alias("at"),
            F.when(n.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(at))).alias("out"),
        )

    return F.aggregate(inner, start, step)["out"]
