"""Roll-ups of scores and metrics: seeds, ensembles, blends, paired comparison, spreads, diffs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.functions.scalars import finite
from lifecurve.operators.ordered import arrange, fits, join_same, spread_before_copies, with_single
from lifecurve.operators.ranks import exact_quantiles
from lifecurve.session import materialize

# Fixed values.
ZSCORE_FLOOR = 1e-12
DIFF_TOLERANCE = 1e-6


def across_seeds(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample std and count of a long metric table, missing values skipped."""
    v = finite(F.col(value))
    return metrics.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n")
    )


def ensemble(
    preds: DataFrame, entity: str, proba: str, *, cutoff: float = 0.5, inclusive: bool = False
) -> DataFrame:
    """Mean and population std of the seeds' probabilities, and the class of the mean."""
    agg = preds.groupBy(entity).agg(
        F.avg(proba).alias("proba_mean"),
        F.stddev_pop(proba).alias("proba_std"),
        F.count(proba).alias("n_seeds"),
    )
    m = F.col("proba_mean")
    return agg.withColumn("pred", (m >= cutoff if inclusive else m > cutoff).cast("int"))


def zscore(df: DataFrame, keys: Sequence[str], value: str, name: str, *, bound: int | None = None) -> DataFrame:
    """Population z-score within the keys; 0 when the spread vanishes."""
    if fits(df, keys, bound):
        w = Window.partitionBy(*keys)
        stats = df.withColumn("_mu", F.avg(value).over(w)).withColumn("_sd", F.stddev_pop(value).over(w))
    else:
        stats = join_same(
            df, df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd")), keys
        )
    z = F.when(F.col("_sd") < ZSCORE_FLOOR, F.lit(0.0)).otherwise(
        F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))
    )
    return stats.withColumn(name, z).drop("_mu", "_sd")


def align_models(preds: DataFrame, on: Sequence[str], model: str, score: str, models: Sequence[str]) -> DataFrame:
    """One row per key with a score column per model; rows some model lacks are dropped."""
    wide = preds.groupBy(*on).agg(
        *[F.max(F.when(F.col(model) == m, F.col(score))).alias(f"score_{m}") for m in models]
    )
    return wide.dropna(subset=[f"score_{m}" for m in models])


def simplex(parts: int, levels: int) -> list[tuple[float, ...]]:
    """Weight vectors on a grid that sum to 1; their number depends on the two arguments only."""
    return [
        tuple(c / levels for c in combo)
        for combo in product(range(levels + 1), repeat=parts)
        if sum(combo) == levels
    ]


def weight_array(grid: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in grid])


def blend(df: DataFrame, scores: Sequence[str], grid: Sequence[Sequence[float]]) -> DataFrame:
    """Each row once per weight vector of a fixed grid: its number ``w_no`` and ``blended``."""
    out = spread_before_copies(df, *scores).select("*", F.posexplode(weight_array(grid)).alias("w_no", "_w"))
    total = F.lit(0.0)
    for i, s in enumerate(scores):
        total = total + F.get(F.col("_w"), i) * F.col(s)
    return out.withColumn("blended", total).drop("_w")


def blend_summary(
    scored: DataFrame, weight: str = "w", value: str = "c_index", keys: Sequence[str] = ()
) -> DataFrame:
    """Best weight by mean score over the seeds, against the pure models at weight 0 and 1.

    The winner must be inside the grid and ahead of the better pure model by more than its own std.
    Ties go to the smaller weight.
    """
    agg = scored.groupBy(*keys, weight).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")
    )
    best = F.max_by(
        F.struct(F.col(weight).alias("w"), F.col("_m").alias("m"), F.col("_s").alias("s")),
        F.struct(F.col("_m"), -F.col(weight)),
    )
    out = agg.groupBy(*keys).agg(
        best.alias("_best"),
        F.max(F.when(F.col(weight) == 0.0, F.col("_m"))).alias("first_alone"),
        F.max(F.when(F.col(weight) == 1.0, F.col("_m"))).alias("second_alone"),
    )
    w, delta = F.col("_best.w"), F.col("_best.m") - F.greatest("first_alone", "second_alone")
    verdict = (
        F.when(~w.isin(0.0, 1.0) & (delta > F.col("_best.s")), "blend wins")
        .when(w == 1.0, "second alone")
        .when(w == 0.0, "first alone")
        .otherwise("blend nudges")
    )
    return out.select(
        *keys,
        w.alias("best_weight"),
        F.col("_best.m").alias("best_mean"),
        F.col("_best.s").alias("best_std"),
        "first_alone",
        "second_alone",
        delta.alias("delta"),
        verdict.alias("verdict"),
    )


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows: a take-ordered step, no full sort."""
    return df.orderBy(*order).limit(k)


def importance_rollup(df: DataFrame, feature: str, value: str) -> DataFrame:
    return df.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def attribution_rollup(df: DataFrame, seed: str, feature: str, value: str) -> DataFrame:
    """Mean absolute attribution per seed and feature, then mean and std over seeds (one seed: std 0)."""
    per_seed = df.groupBy(seed, feature).agg(F.avg(F.abs(value)).alias("_a"))
    return per_seed.groupBy(feature).agg(
        F.avg("_a").alias("mean_abs"),
        F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("std_abs"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def attribution_long(wide: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide attribution table -> (keys, feature, value)."""
    return wide.unpivot(list(keys), list(features), "feature", "value")


def set_fingerprint(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Order-insensitive digest of the distinct names of a key, by one rule at every size.

    Two limbs of each name's md5 are summed, which combines on the map side; the digest is 16 hex digits
    of sha256 over the count and both sums.
    """
    rows = df.select(*keys, F.md5(F.col(name).cast("string")).alias("_h"), F.col(name).cast("string").alias("_name")).distinct()

    def limb(start):
        return F.sum(F.conv(F.substring("_h", start, 15), 16, 10).cast("decimal(20,0)"))

    sums = rows.where("_name is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), limb(1).alias("_a"), limb(16).alias("_b"))
    said = F.concat_ws("/", F.col("n").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return sums.select(*keys, "n", F.substring(F.sha2(said, 256), 1, 16).alias("fingerprint"))


def split_check(train: DataFrame, test: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Per key: rows of both sides, entities on both sides, duplicates. A clean split has 0 and 0."""
    sides = train.select(*keys, entity, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).unionByName(
        test.select(*keys, entity, F.lit(0).alias("_tr"), F.lit(1).alias("_te"))
    )
    per = sides.groupBy(*keys, entity).agg(F.sum("_tr").alias("_tr"), F.sum("_te").alias("_te"))
    return per.groupBy(*keys).agg(
        F.sum("_tr").alias("n_train"),
        F.sum("_te").alias("n_test"),
        F.count_if((F.col("_tr") > 0) & (F.col("_te") > 0)).alias("n_leaked"),
        F.count_if((F.col("_tr") > 1) | (F.col("_te") > 1)).alias("n_duplicated"),
    )


def same_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Do two runs hold the same names per key? Keys of one run only are reported as different.

    Names are compared themselves: those of one side only are counted.
    """
    sides = a.select(*keys, F.col(name).alias("_name"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.col(name).alias("_name"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = sides.groupBy(*keys, "_name").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n_a, n_b = F.sum("_a"), F.sum("_b")
    return per.groupBy(*keys).agg(
        F.nullif(n_a, F.lit(0)).alias("n_a"), F.nullif(n_b, F.lit(0)).alias("n_b"), (F.count_if(F.col("_a") != F.col("_b")) == 0).alias("same")
    )


def representative(df: DataFrame, keys: Sequence[str], position: str, numeric: Sequence[str], other: Sequence[str], *, bound: int | None = None) -> DataFrame:
    """One value per parameter: exact median for numeric ones, else the mode (first seen on ties)."""
    out = df.select(*keys).distinct()
    for c in numeric:
        out = join_same(out, exact_quantiles(df, keys, c, {c: 0.5}, bound=bound), keys, "left")
    for c in other:
        out = join_same(out, mode_of(df, keys, c, position), keys, "left")
    return out


def mode_of(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Most frequent value; the one seen first on ties."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_p")
    )
    return counts.groupBy(*keys).agg(F.max_by("_v", F.struct(F.col("_n"), -F.col("_p"))).alias(value))


def parameter_spread(df: DataFrame, keys: Sequence[str], value: str, position: str, *, bound: int | None = None) -> DataFrame:
    """Mode, distinct values, exact median and range of one parameter."""
    basics = df.groupBy(*keys).agg(
        F.count_distinct(value).alias("n_unique"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    mode = mode_of(df, keys, value, position).withColumnRenamed(value, "mode")
    med = exact_quantiles(df, keys, value, {"median": 0.5}, bound=bound)
    return join_same(join_same(basics, mode, keys), med, keys, "left")


def uncertainty_profile(df: DataFrame, keys: Sequence[str], value: str, limit: float, *, bound: int | None = None) -> DataFrame:
    """Mean, exact p50/p90/p99 and how many exceed the limit; missing values skipped."""
    basics = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
        F.count_if(F.col(value) > limit).alias("n_over"),
    )
    q = exact_quantiles(df, keys, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, bound=bound)
    return join_same(basics, q, keys, "left") if keys else with_single(basics, q)


def feature_summary(df: DataFrame, cohort: str, features: Sequence[str]) -> DataFrame:
    """Mean, std and count per cohort and feature, NaN skipped."""
    long = df.unpivot([cohort], list(features), "feature", "_v").withColumn("_v", finite(F.col("_v")))
    return long.groupBy(cohort, "feature").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("n")
    )


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null-or-NaN count per column, one row per column."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    cols = list(columns or df.columns)

    def gone(c):
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    wide = df.agg(*[F.count_if(gone(c)).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows"))
    return wide.unpivot(["_rows"], cols, "column", "n_missing").withColumnRenamed("_rows", "n_rows")


def describe_columns(df: DataFrame, columns: Sequence[str], *, bound: int | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per numeric column."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], list(columns), "column", "_v")
    basics = long.groupBy("column").agg(
        F.count("_v").alias("n"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    q = exact_quantiles(long, ["column"], "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, bound=bound)
    return join_same(basics, q, ["column"], "left")


def metric_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """Mean value per key, one column per listed level."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(value))


def pivot_delta(df: DataFrame, keys: Sequence[str], column: str, a: str, b: str, value: str) -> DataFrame:
    """Level a, level b and a - b per key."""
    wide = metric_pivot(df, keys, column, [a, b], value)
    return wide.withColumn("delta", F.col(a) - F.col(b))


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, "value"
    )


def improvement_pct(
    df: DataFrame, keys: Sequence[str], level: str, base: str, other: str, value: str, lower_is_better: str
) -> DataFrame:
    """Improvement of level ``other`` over ``base`` in percent, positive = better."""
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(level) == base, F.col(value))).alias("base_value"),
        F.avg(F.when(F.col(level) == other, F.col(value))).alias("other_value"),
        F.bool_or(lower_is_better).alias("_lower"),
    )
    change = F.try_divide(F.col("other_value") - F.col("base_value"), F.col("base_value")) * 100.0
    return agg.withColumn("improvement_pct", F.when(F.col("_lower"), -change).otherwise(change)).drop("_lower")


def paired_deltas(
    df: DataFrame, seed: str, level: str, metrics: Sequence[str], levels: Sequence | None = None
) -> DataFrame:
    """Per-seed differences (larger level - smaller level), in points, for every pair of levels of the data.

    Levels are settings, so a seed has few; they are put in order and paired inside the seed's row, and no
    rows are joined with each other. ``levels`` restricts them. A metric missing at a level gives no delta.
    """
    if levels is not None:
        df = df.where(F.col(level).isin(list(levels)))
    one = df.where(F.col(level).isNotNull()).groupBy(seed, level).agg(*[F.max(m).alias(m) for m in metrics])
    row = F.struct(F.col(level).alias("lvl"), *[F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metrics)])
    per = one.groupBy(seed).agg(F.sort_array(F.collect_list(row)).alias("_at"))

    def cells(a, b):
        each = [
            F.struct(b["lvl"].alias("big"), a["lvl"].alias("small"), F.lit(m).alias("metric"), ((b[f"m{k}"] - a[f"m{k}"]) * 100.0).alias("delta"))
            for k, m in enumerate(metrics)
        ]
        return F.array(*each)

    pairs = F.transform("_at", lambda b, i: F.flatten(F.transform(F.slice("_at", 1, i), lambda a: cells(a, b))))
    found = per.select(seed, F.inline(F.flatten(pairs)))
    # Pairs of levels that no seed has both of: one row without a delta each, so that the summary names them.
    met = F.sort_array(F.collect_set(F.col(level)))
    both = F.transform(met, lambda b, i: F.transform(F.slice(met, 1, i), lambda a: F.struct(b.alias("big"), a.alias("small"))))
    every = df.where(F.col(level).isNotNull()).agg(F.flatten(both).alias("_pairs")).select(F.inline("_pairs"))
    every = every.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    none = every.select(F.lit(None).cast(dict(found.dtypes)[seed]).alias(seed), "big", "small", "metric", F.lit(None).cast("double").alias("delta"))
    return found.unionByName(none)


def paired_summary(deltas: DataFrame) -> DataFrame:
    """Mean difference, t statistic and Cohen's d per pair and metric; too few seeds give a note."""
    agg = deltas.groupBy("big", "small", "metric").agg(
        F.count("delta").alias("n_seeds"),
        F.avg("delta").alias("_mean"),
        F.stddev_samp("delta").alias("_sd"),
    )
    enough = F.col("n_seeds") >= 2
    d = F.when(enough & (F.col("_sd") > 0), F.col("_mean") / F.col("_sd"))
    return agg.select(
        "big",
        "small",
        "metric",
        "n_seeds",
        F.when(enough, F.col("_mean")).alias("delta_pp"),
        (d * F.sqrt(F.col("n_seeds"))).alias("t_stat"),
        d.alias("cohens_d"),
        F.when(F.col("n_seeds") == 0, "no overlapping seeds")
        .when(~enough, "fewer than 2 paired seeds")
        .otherwise("different entity pools per level (paired only on seed)")
        .alias("note"),
    )


def student_p_value(t: Column, dof: Column, steps: int = 400) -> Column:
    """Two-sided p of Student's t, by Simpson's rule on the density after x = tan(theta).

    p = 1 - 2 c * integral_0^atan(|t| / sqrt(dof)) cos(theta)^(dof - 1), c from log-gamma by
    Stirling's series (shifted by 8).
    """

    def log_gamma(x):
        shift = F.lit(0.0)
        for i in range(8):
            shift = shift + F.log(x + float(i))
        y = x + 8.0
        series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift

    v = dof.cast("double")
    end = F.atan(F.abs(t) / F.sqrt(v))
    h = end / float(steps)
    body = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)),
        F.lit(0.0),
        lambda acc, i: acc
        + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        * F.pow(F.cos(i * h), v - 1.0),
    )
    c = F.exp(log_gamma((v + 1.0) / 2.0) - log_gamma(v / 2.0)) / F.sqrt(F.lit(3.141592653589793))
    return F.greatest(1.0 - 2.0 * c * body * h / 3.0, F.lit(0.0))


#: Rows that one block of draws covers; blocks of a key share its draws by binomial cuts.
BOOTSTRAP_BLOCK = 4096
#: Multipliers of the draw hash, modulo the prime 2^31 - 1.
_PRIME, _MIX = (1 << 31) - 1, (1_103_515_245, 1_664_525, 48_271)


def draw_hash(mark: np.ndarray | int, replicate: np.ndarray | int, slot: np.ndarray | int) -> np.ndarray:
    """A repeatable number below 2^31 - 1 for a draw; SQL can follow it."""
    x = (np.asarray(replicate, np.int64) * _MIX[0] + mark) % _PRIME
    x = ((x ^ (x >> 13)) * _MIX[1] + np.asarray(slot, np.int64)) % _PRIME
    x = ((x ^ (x >> 17)) * _MIX[2] + 1) % _PRIME
    return ((x ^ (x >> 11)) * _MIX[0]) % _PRIME


def block_draws(mark: int, n: int, block: int, replicates: int, block_rows: int = BOOTSTRAP_BLOCK) -> np.ndarray:
    """How many of a key's n draws fall into a block of rows, for every replicate.

    The draws of a span of blocks are cut in two by binomial numbers, from the whole key down to the block;
    each cut has a generator of its own (key and span), so every task finds the same numbers.
    """
    count = -(-n // block_rows)
    low, high, draws = 0, count, np.full(replicates, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left, whole = (mid - low) * block_rows, min(high * block_rows, n) - low * block_rows
        cut = np.random.Generator(np.random.Philox(key=[mark, (low << 32) | high])).binomial(draws, left / whole)
        low, high, draws = (low, mid, cut) if block < mid else (mid, high, draws - cut)
    return draws


#: Draws that are worked on at once: few enough for a core's cache.
DRAWS_AT_ONCE = 1 << 15


def _reduce(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo 2^31 - 1 in place, for x below 2^62: the high bits are added to the low ones, without a division."""
    np.right_shift(x, 31, out=spare)
    x &= _PRIME
    x += spare
    np.subtract(x, _PRIME, out=spare)  # wraps to a large number where x is small enough
    np.minimum(x, spare, out=x)


def block_sums(mark: int, n: int, block: int, values: np.ndarray, replicates: int, block_rows: int = BOOTSTRAP_BLOCK) -> np.ndarray:
    """Sum of the values drawn from a block in every replicate.

    The draws are those of ``draw_hash`` for the mark and block: its first step once per replicate, the others for a few
    replicates at once, in place.
    """
    draws, out = block_draws(mark, n, block, replicates, block_rows), np.zeros(replicates)
    first = (np.arange(1, replicates + 1, dtype=np.int64) * _MIX[0] + (mark + block)) % _PRIME
    first = (((first ^ (first >> 13)) * _MIX[1]) % _PRIME).astype(np.uint64)
    slots = np.arange(1, int(draws.max(initial=0)) + 1, dtype=np.uint64)
    step = max(1, DRAWS_AT_ONCE // max(1, len(slots)))
    for at in range(0, replicates, step):
        k = draws[at : at + step]
        width = int(k.max())
        if not width:
            continue
        x = first[at : at + step, None] + slots[:width]
        spare = np.empty_like(x)
        _reduce(x, spare)
        for shift, factor, more in ((17, _MIX[2], 1), (11, _MIX[0], 0)):
            np.right_shift(x, shift, out=spare)
            x ^= spare
            x *= factor
            x += more
            _reduce(x, spare)
        np.floor_divide(x, len(values), out=spare)
        spare *= len(values)
        x -= spare
        picked = values.take(x.view(np.int64)).ravel()
        starts = np.arange(len(k)) * width
        ends = np.stack([starts, starts + k], axis=1).ravel()
        sums = np.add.reduceat(picked, ends[:-1] if ends[-1] == len(picked) else ends)[::2]
        out[at : at + step] = np.where(k > 0, sums, 0.0)
    return out


def bootstrap_mean_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str],
    *,
    replicates: int = 10_000,
    alpha: float = 0.05,
    seed: int = 20260514,
    block_rows: int = BOOTSTRAP_BLOCK,
    bound: int | None = None,
) -> DataFrame:
    """Percentile interval of the mean under resampling with replacement, plain and repeatable.

    Rows are numbered per key and cut into blocks; every block draws for itself (``block_draws`` tells how many of the
    key's n draws are its own, ``draw_hash`` which rows), so no draw is shuffled: a block gives one sum per replicate,
    and blocks are added on the map side. A key with very many rows is as many blocks as it needs.
    """
    # Written once: counting the keys, the numbers and the sizes would each run what leads to the rows again.
    known = materialize(df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v")))
    rows = arrange(known, keys, order, bound=bound).position("_i").rows()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    mark = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    blocks = rows.groupBy(*keys, F.floor((F.col("_i") - 1) / block_rows).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_i", "_v")))["_v"].alias("_values"))
    blocks = join_same(blocks, sizes, keys).withColumn("_mark", mark)
    # A block is little to read and much to compute.
    blocks = spread_before_copies(blocks, *keys, "_block")
    kinds = dict(blocks.dtypes)

    def draw(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                cell = lambda c: one.column(c)[0].as_py()
                sums = block_sums(cell("_mark"), cell("_n"), cell("_block"), np.array(cell("_values")), replicates, block_rows)
                cells = [pa.array([cell(c)] * replicates, one.schema.field(c).type) for c in [*keys, "_n"]]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.arange(1, replicates + 1)), pa.array(sums)], names=[*keys, "_n", "_rep", "_sum"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_n long, _rep long, _sum double"])
    means = blocks.mapInArrow(draw, schema).groupBy(*keys, "_rep").agg((F.sum("_sum") / F.max("_n")).alias("_mean"))
    return exact_quantiles(means, keys, "_mean", {"ci_lo": alpha / 2, "ci_hi": 1 - alpha / 2}, bound=replicates)


def snapshot_diff(
    new: DataFrame, ref: DataFrame, key: str, columns: Sequence[str], tolerance: float = DIFF_TOLERANCE
) -> DataFrame:
    """Per column over keys of both snapshots: identical, different, missing on one side, sizes."""
    long = [
        side.select(key, *[finite(F.col(c)).alias(c) for c in columns]).unpivot([key], list(columns), "column", f"_{n}")
        for side, n in ((new, "a"), (ref, "b"))
    ]
    both = long[0].join(long[1], [key, "column"])
    a, b = F.col("_a"), F.col("_b")
    gap = F.abs(a - b)
    same = (a.isNull() & b.isNull()) | F.coalesce(gap <= tolerance, F.lit(False))
    differs = F.when(gap > tolerance, gap)
    return both.groupBy("column").agg(
        F.count_if(same).alias("n_identical"),
        F.count(differs).alias("n_diff"),
        F.coalesce(F.max(differs), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.avg(differs), F.lit(0.0)).alias("mean_abs_diff"),
        F.count_if(a.isNull() != b.isNull()).alias("n_missing_flip"),
    )


def snapshot_join(new: DataFrame, ref: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer join of two snapshots on one coalesced key."""
    sides = [
        df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in columns]) for df, s in ((new, "new"), (ref, "ref"))
    ]
    return sides[0].join(sides[1], [key], "full")


def flag_changes(new: DataFrame, ref: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """How many shared keys changed each status flag."""
    both = snapshot_join(new, ref, key, flags)
    both = both.join(new.select(key), key, "left_semi").join(ref.select(key), key, "left_semi")
    wide = both.agg(
        *[F.count_if(F.col(f"{f}_new") != F.col(f"{f}_ref")).alias(f) for f in flags]
    )
    return wide.unpivot([], list(flags), "flag", "n_changed")


def strongest_class(df: DataFrame, entity: str, kind: str, ranking: Mapping[str, int]) -> DataFrame:
    """The highest-ranked class among an entity's candidates."""
    rank = F.lit(None).cast("int")
    for name, r in ranking.items():
        rank = F.when(F.col(kind) == name, r).otherwise(rank)
    return df.groupBy(entity).agg(F.max_by(kind, rank).alias("strongest"))


def pass_rates(df: DataFrame, horizons: Sequence[int], column: str = "pass_n{n}") -> DataFrame:
    """Pass rate per horizon and whether it does not rise with the horizon."""
    wide = df.agg(*[F.avg(F.col(column.format(n=n)).cast("double")).alias(str(n)) for n in horizons])
    cells, previous = [], None
    for n in sorted(horizons):
        rate = F.col(str(n))
        falls = F.lit(None).cast("boolean") if previous is None else rate <= F.col(str(previous))
        cells.append(F.struct(F.lit(n).alias("horizon"), rate.alias("pass_rate"), falls.alias("not_rising")))
        previous = n
    return wide.select(F.inline(F.array(*cells)))


def latest_per(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row per key by ``order``: one mergeable aggregate instead of a window."""
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    ).select(*keys, "_row.*")


def first_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, *, bound: int | None = None
) -> DataFrame:
    """The first k rows of each group in a unique order."""
    return arrange(df, keys, order, bound=bound).position("_k").where(F.col("_k") <= k).rows().drop("_k")


def primary_candidate(df: DataFrame, entity: str, order: str) -> DataFrame:
    """The earliest candidate of each entity and how many more it has."""
    values = [c for c in df.columns if c != entity]
    return df.groupBy(entity).agg(
        F.min_by(F.struct(*values), F.col(order)).alias("_row"), (F.count(F.lit(1)) - 1).alias("n_extra")
    ).select(entity, "_row.*", "n_extra")


def categorized_picks(df: DataFrame, entity: str, categories: Sequence[tuple[str, Column, Column, int]]) -> DataFrame:
    """Top-k entities per category; an entity named twice keeps its first category.

    Each category is (name, condition, sort key with larger first, k). One ordered take per category,
    never a full sort; the union holds at most sum(k) rows.
    """
    picks = None
    for i, (name, cond, key, k) in enumerate(categories):
        part = (
            df.where(cond)
            .select(entity, F.lit(i).alias("_i"), F.lit(name).alias("category"), key.cast("double").alias("sort_key"))
            .orderBy(F.col("sort_key").desc_nulls_last(), F.col(entity))
            .limit(k)
        )
        picks = part if picks is None else picks.unionByName(part)
    return picks.groupBy(entity).agg(
        F.min_by(F.struct("category", "sort_key"), "_i").alias("_p")
    ).select(entity, "_p.*")


def max_abs_gap(a: DataFrame, b: DataFrame, on: Sequence[str], left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest absolute difference of two measurements of the same thing."""
    return a.join(b, list(on)).groupBy(*keys).agg(
        F.max(F.abs(F.col(left) - F.col(right))).alias("max_abs_gap"), F.count(F.lit(1)).alias("n")
    )
