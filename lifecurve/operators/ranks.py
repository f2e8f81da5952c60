"""Operators that need ranks of values: quantiles, AUC, ROC points, rank pairing.

Rows are first combined per distinct value, so only distinct values are ordered, and running sums
come from ``ordered``: no unpartitioned window and no list of values in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.ordered import Ordered, arrange, chunk_rows, join_same, largest_group, with_single
from lifecurve.session import materialize


# Largest key for which the built-in exact percentile, which keeps all values of a key, is used.
PERCENTILE_ROWS = 100_000
SKETCH_ACCURACY = 1_000
# Half width of a bracket in units of the sketch's rank error.
SKETCH_MARGIN = 3.0


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, bound: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key, exact; nulls are skipped.

    Small keys (by bound or by count) use the built-in percentile. Larger ones are bracketed by a
    mergeable sketch first; only the values inside the bracket are ordered, and the rows below it are
    counted. For a key whose bracket misses the wanted rank, all its distinct values are ordered instead.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    limit = min(PERCENTILE_ROWS, chunk_rows(df.sparkSession))
    if bound is not None and (bound <= limit or not keys):
        top = bound
    else:
        top = largest_group(rows, keys)[0]
    if top <= limit:
        return rows.groupBy(*keys).agg(*[F.percentile("_v", float(p)).alias(n) for n, p in probs.items()])

    margin = SKETCH_MARGIN / SKETCH_ACCURACY
    edges = [e for p in probs.values() for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.percentile_approx("_v", edges, SKETCH_ACCURACY).alias("_edges")
    )
    marked = join_same(rows, sketch, keys) if keys else with_single(rows, sketch)
    v = F.col("_v")
    cells = []
    for i, p in enumerate(probs.values()):
        low, high = F.get("_edges", 2 * i), F.get("_edges", 2 * i + 1)
        inside = F.lit(True) if p - margin <= 0 else v >= low
        upto = F.lit(True) if p + margin >= 1 else v <= high
        cells.append(F.when(upto, F.struct(F.lit(i).alias("i"), F.when(inside, v).alias("at"))))
    counts = (
        marked.select(*keys, "_all", F.explode(F.array_compact(F.array(*cells))).alias("_c"))
        .groupBy(*keys, "_c.i", "_c.at")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"))
    )
    inner = None if bound is None else 10 + math.ceil(bound * 10 / SKETCH_ACCURACY)
    o = arrange(counts, [*keys, "i"], ["at"], bound=inner).running(_cum=F.col("_n"))
    wanted = F.lit(None).cast("double")
    for i, p in enumerate(probs.values()):
        wanted = F.when(F.col("i") == i, F.lit(float(p))).otherwise(wanted)
    h = (F.col("_all") - 1) * wanted
    known = F.col("at").isNotNull()
    picked = o.rows().groupBy(*keys, "i").agg(
        F.min(F.when(known & (F.col("_cum") > F.floor(h)), F.col("at"))).alias("_lo"),
        F.min(F.when(known & (F.col("_cum") > F.ceil(h)), F.col("at"))).alias("_hi"),
        F.max(h - F.floor(h)).alias("_f"),
        F.max(F.when(~known, F.col("_cum") > F.floor(h))).alias("_missed"),
    )
    missed = F.col("_lo").isNull() | F.col("_hi").isNull() | F.coalesce("_missed", F.lit(False))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    # One row per key and probability: written, so that asking for misses does not run the passes twice.
    found = materialize(picked.select(*keys, F.col("i"), F.when(~missed, between).alias("_q"), missed.alias("_miss")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(n) for i, n in enumerate(probs)])
    again = found.where("_miss").select(*keys).distinct()
    if again.isEmpty():
        return wide
    if not keys:
        return ordered_quantiles(rows, keys, probs, bound=bound)
    redone = ordered_quantiles(join_same(rows, again, keys, "left_semi"), keys, probs, bound=bound)
    return join_same(wide, again, keys, "left_anti").unionByName(redone)


def ordered_quantiles(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float], *, bound: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles of ``_v`` per key from its distinct values in order; no size is assumed."""
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    o = arrange(counts, keys, ["_v"], bound=bound).running(_cum=F.col("_n"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    placed = join_same(o.rows(), total, keys) if keys else with_single(o.rows(), total)
    edges = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_all") - 1) * F.lit(float(p))
        edges += [
            F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
    at = placed.groupBy(*keys).agg(*edges)
    return at.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(probs)])


def attach_quantile(o: Ordered, name: str, value: str, prob: float) -> Ordered:
    """Exact quantile of ``value`` per key on every row."""
    if o.chunk is None:
        return o.attach(**{name: F.percentile(F.col(value).cast("double"), float(prob))})
    return o.join_facts(exact_quantiles(o.df, list(o.keys), value, {name: prob}))


def with_scopes(df: DataFrame, cohort: str, scope: str = "scope", overall: str = "all") -> DataFrame:
    """Each row once for the whole and once for its cohort (used on combined rows, not raw ones)."""
    return df.withColumn(
        scope, F.explode(F.array_compact(F.array(F.lit(overall), F.col(cohort).cast("string"))))
    )


def score_counts(
    df: DataFrame, keys: Sequence[str], label: str, score: str, weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score."""
    one = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(0.0)).alias("_pos"),
        F.count_if(F.col(label) != 1).cast("double").alias("_neg"),
    )


def auc_from_counts(counts: DataFrame, keys: Sequence[str], *, bound: int | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties one half; null with one class."""
    o = arrange(counts, keys, ["_s"], bound=bound).running(_below=F.col("_neg"))
    rows = o.rows()
    won = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") * 0.5))
    agg = rows.groupBy(*keys).agg(
        won.alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q")
    )
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return agg.select(*keys, F.when(both, F.col("_won") / (F.col("_p") * F.col("_q"))).alias("auc"))


def roc_auc(
    df: DataFrame, keys: Sequence[str], label: str, score: str, *, bound: int | None = None
) -> DataFrame:
    return auc_from_counts(score_counts(df, keys, label, score), keys, bound=bound)


def roc_points(
    df: DataFrame, keys: Sequence[str], label: str, score: str, *, bound: int | None = None
) -> DataFrame:
    """One point per distinct score used as threshold: counts at or above it, rates, confusion."""
    counts = score_counts(df, keys, label, score)
    o = arrange(counts, keys, ["_s"], bound=bound)
    o = o.running(_fn_in=F.col("_pos"), _tn_in=F.col("_neg")).attach(_p=F.sum("_pos"), _q=F.sum("_neg"))
    fn, tn = F.col("_fn_in") - F.col("_pos"), F.col("_tn_in") - F.col("_neg")
    tp, fp = F.col("_p") - fn, F.col("_q") - tn
    return o.rows().select(
        *keys,
        F.col("_s").alias("threshold"),
        tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        tn.cast("long").alias("tn"),
        F.try_divide(tp, F.col("_p")).alias("tpr"),
        F.try_divide(fp, F.col("_q")).alias("fpr"),
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, bound: int | None = None
) -> Ordered:
    """1-based rank by a unique order."""
    return arrange(df, keys, order, bound=bound).position(name)


def rank_calibration(
    df: DataFrame,
    fold: str,
    entity: str,
    risk: str,
    life: str,
    *,
    bound: int | None = None,
) -> DataFrame:
    """Give the k-th highest risk of a fold the k-th shortest true life of the fold."""
    by_risk = ranked(
        df.select(fold, entity, (-F.col(risk)).alias("_neg_risk")), [fold], ["_neg_risk", entity], "rank", bound=bound
    ).rows()
    by_life = ranked(
        df.select(fold, F.col(entity).alias("_other"), F.col(life).alias("calibrated_life")),
        [fold],
        ["calibrated_life", "_other"],
        "rank",
        bound=bound,
    ).rows()
    return join_same(
        by_risk.drop("_neg_risk"), by_life.drop("_other"), [fold, "rank"]
    )
