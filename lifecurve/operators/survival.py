"""Censoring-aware operators: survival curves, concordance and metrics at a horizon."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.metrics import ratio_or_zero
from lifecurve.operators.ordered import arrange, chunk_rows, join_on, join_same, spread_before_copies
from lifecurve.operators.ranks import auc_from_counts, exact_quantiles, roc_auc, score_counts


def _is(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("boolean"), F.lit(False))


def survival_curve(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    event: str,
    *,
    censoring: bool = False,
    extra_times: DataFrame | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Kaplan-Meier steps per key: time, n_at_risk, n_events, survival.

    ``censoring`` estimates the censoring distribution instead (rows failing at t leave the risk set
    first). ``extra_times`` (keys, time) asks for the value at further times. Rows are combined per
    distinct time; the product is a running sum of logarithms.
    """
    per_time = df.groupBy(*keys, F.col(time).alias("time")).agg(
        F.count_if(_is(event)).alias("_d"), F.count_if(~_is(event)).alias("_c")
    )
    if extra_times is not None:
        zero = F.lit(0).cast("long")
        more = extra_times.select(*keys, F.col(time).alias("time"), zero.alias("_d"), zero.alias("_c"))
        per_time = per_time.unionByName(more).groupBy(*keys, "time").agg(
            F.sum("_d").alias("_d"), F.sum("_c").alias("_c")
        )
    o = arrange(per_time, keys, ["time"], bound=bound)
    o = o.running(_gone=F.col("_d") + F.col("_c")).attach(_all=F.sum(F.col("_d") + F.col("_c")))
    before = F.col("_gone") - F.col("_d") - F.col("_c")
    if censoring:
        o = o.add(n_at_risk=F.col("_all") - before - F.col("_d"), n_events=F.col("_c"))
    else:
        o = o.add(n_at_risk=F.col("_all") - before, n_events=F.col("_d"))
    left = F.col("n_at_risk") - F.col("n_events")
    o = o.add(
        _log=F.when((F.col("n_events") > 0) & (left > 0), F.log(left / F.col("n_at_risk"))).otherwise(0.0),
        _end=F.when((F.col("n_events") > 0) & (left <= 0), 1).otherwise(0),
    ).running(_sum=F.col("_log"), _ended=F.col("_end"))
    return o.rows().select(
        *keys,
        "time",
        "n_at_risk",
        "n_events",
        F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_sum")).alias("survival"),
    )


def median_survival(curve: DataFrame, keys: Sequence[str], cap: float) -> DataFrame:
    """Smallest time with survival <= 0.5, else the cap."""
    below = F.min(F.when(F.col("survival") <= 0.5, F.col("time")))
    return curve.groupBy(*keys).agg(F.coalesce(below.cast("double"), F.lit(float(cap))).alias("median_time"))


def time_ranks(df: DataFrame, keys: Sequence[str], time: str, event: str, *, bound: int | None = None) -> DataFrame:
    """``_rank`` of the time per key (event before censored at equal time) and ``_top``, the last one; null without a time.

    Rows that are scored in many ways (blends) are ranked once, before they are copied.
    """
    cens = F.when(_is(event), 0).otherwise(1)
    rows = df.withColumns({"_t": F.col(time), "_cens": cens})
    times = rows.where(F.col(time).isNotNull()).select(*keys, "_t", "_cens").distinct()
    ranks = arrange(times, keys, ["_t", "_cens"], bound=bound).position("_rank").attach(_top=F.max("_rank"))
    return join_same(rows, ranks.rows(), [*keys, "_t", "_cens"], "left").drop("_t", "_cens")


def concordance(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    event: str,
    risk: str,
    *,
    min_events: int = 2,
    ranked: bool = False,
    many_keys: bool = False,
    bound: int | None = None,
) -> DataFrame:
    """Harrell's concordance per key, without forming pairs.

    A pair is comparable when the earlier row is an event; at equal times when one is an event and
    the other censored. It is concordant when the earlier row has the higher risk; ties count one half.

    Times are ranked (event before censored at equal time). Two ranks differ first in one binary
    digit, so each comparable pair meets in exactly one (digit, prefix) node, the earlier row on the
    zero side. Per node one running sum over risk counts the pairs: n log n rows, no pair list, and
    the running sum splits big nodes over chunks. ``ranked``: the rows come from ``time_ranks`` by some of the keys.
    ``many_keys``: there are enough keys to spread the work (blends); where ``bound`` proves that each fits one task,
    only the rows are shuffled, once, and the nodes of a key are counted where its rows meet (``pairs_of_key``).
    """
    rows = df if ranked else time_ranks(df, keys, time, event, bound=bound)
    if many_keys and keys and bound is not None and bound <= chunk_rows(df.sparkSession):
        return _concordance_of_keys(rows, keys, event, risk, min_events)
    rows = rows.where(F.col("_rank").isNotNull() & F.col(risk).isNotNull()).groupBy(
        *keys, "_rank", "_top", F.when(_is(event), 0).otherwise(1).alias("_cens"), F.col(risk).cast("double").alias("_r")
    ).agg(F.count(F.lit(1)).alias("_n"))
    rows = spread_before_copies(rows, *keys, "_rank", "_r")
    # Number of binary digits of the largest zero-based rank.
    digits = F.length(F.bin(F.col("_top") - 1))
    zero_based = F.col("_rank") - 1
    nodes = (
        rows.withColumn("_level", F.explode(F.sequence(F.lit(0), digits - 1)))
        .withColumn("_bits", F.call_function("shiftright", zero_based, F.col("_level")))
        .withColumn("_node", F.call_function("shiftright", F.col("_bits"), F.lit(1)))
        .withColumn("_late", F.col("_bits").bitwiseAND(F.lit(1)) == 1)
        .groupBy(*keys, "_level", "_node", "_r")
        .agg(
            F.sum(F.when(~F.col("_late") & (F.col("_cens") == 0), F.col("_n")).otherwise(0)).alias("_first"),
            F.sum(F.when(F.col("_late"), F.col("_n")).otherwise(0)).alias("_second"),
        )
    )
    at = [*keys, "_level", "_node"]
    o = arrange(nodes, at, ["_r"], bound=bound).running(_upto=F.col("_second")).attach(_later=F.sum("_second"))
    pairs = o.rows().groupBy(*keys).agg(
        F.sum(F.col("_first") * (2 * F.col("_upto") - F.col("_second"))).alias("_won2"),
        F.sum(F.col("_first") * F.col("_later")).alias("_pairs"),
    )
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(_is(event)).alias("n_events"))
    ok = (F.col("n_events") >= min_events) & (F.col("_pairs") > 0)
    return join_same(totals, pairs, keys, "left").select(
        *keys,
        "n",
        "n_events",
        F.coalesce("_pairs", F.lit(0)).alias("n_pairs"),
        F.when(ok, F.col("_won2") / (2.0 * F.col("_pairs"))).alias("c_index"),
    )


def pairs_of_key(rank: np.ndarray, starts: np.ndarray, risk: np.ndarray) -> tuple[int, int]:
    """(twice the pairs won, comparable pairs) of one key: ranks from 0, whether a row's time is an event, risks.

    Digit by digit of the rank as in ``concordance``: the rows stay ordered by (node, risk), and running counts of the
    late rows give those of lower and of equal risk for every early event.
    """
    order = np.argsort(risk, kind="stable")
    rank, starts, risk = rank[order], starts[order], risk[order]
    differs = (risk[1:] != risk[:-1]) & ~(np.isnan(risk[1:]) & np.isnan(risk[:-1]))
    level_of_risk = np.cumsum(np.concatenate([[0], differs]))
    won2 = pairs = 0
    for level in range(int(rank.max(initial=0)).bit_length()):
        bits = rank >> level
        node = bits >> 1
        by = np.argsort(node.astype(np.uint16) if node.max() < 1 << 16 else node, kind="stable")
        node, late = node[by], (bits[by] & 1).astype(bool)
        same = level_of_risk[by]
        new_node = np.concatenate([[True], node[1:] != node[:-1]])
        new_risk = new_node | np.concatenate([[True], same[1:] != same[:-1]])
        upto = np.concatenate([[0], np.cumsum(late)])
        group, home = np.flatnonzero(new_risk), np.flatnonzero(new_node)
        of_group, of_home = np.cumsum(new_risk) - 1, np.cumsum(new_node) - 1
        early = ~late & starts[by]
        below, through = upto[group], upto[np.append(group[1:], len(by))]
        before, whole = upto[home], upto[np.append(home[1:], len(by))]
        won2 += int((below + through)[of_group[early]].sum() - 2 * before[of_home[early]].sum())
        pairs += int((whole - before)[of_home[early]].sum())
    return won2, pairs


def _concordance_of_keys(rows: DataFrame, keys: Sequence[str], event: str, risk: str, min_events: int) -> DataFrame:
    """``concordance`` of ranked rows, all rows of a key in one task."""
    there = F.col("_rank").isNotNull() & F.col(risk).isNotNull()
    rank = F.when(there, F.col("_rank") - 1).otherwise(-1).cast("long")
    narrow = rows.select(*keys, rank.alias("_rank"), _is(event).alias("_starts"), F.coalesce(F.col(risk).cast("double"), F.lit(0.0)).alias("_r"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(narrow.dtypes)

    def count(key, table):
        rank, starts, risk = (table.column(c).to_numpy() for c in ("_rank", "_starts", "_r"))
        used = rank >= 0
        won2, pairs = pairs_of_key(rank[used], starts[used], risk[used])
        found = {"n": len(rank), "n_events": int(starts.sum()), "n_pairs": pairs, "_won2": won2}
        cells = [pa.array([k.as_py()], k.type) for k in key] + [pa.array([v], pa.int64()) for v in found.values()]
        return pa.Table.from_arrays(cells, names=[*keys, *found])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, n_events long, n_pairs long, _won2 long"])
    counts = narrow.repartition(n, *keys).groupBy(*keys).applyInArrow(count, schema)
    ok = (F.col("n_events") >= min_events) & (F.col("n_pairs") > 0)
    return counts.select(*keys, "n", "n_events", "n_pairs", F.when(ok, F.col("_won2") / (2.0 * F.col("n_pairs"))).alias("c_index"))


def usable_at(df: DataFrame, time: str, event: str, horizon: int) -> DataFrame:
    """Rows whose outcome at the horizon is known, with ``failed``; censored before it are dropped."""
    failed = _is(event) & (F.col(time) <= horizon)
    return df.where(failed | (F.col(time) > horizon)).withColumn("failed", failed.cast("int"))


def auc_at_horizon(
    df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, horizon: int, *, bound: int | None = None
) -> DataFrame:
    out = roc_auc(usable_at(df, time, event, horizon), keys, "failed", risk, bound=bound)
    return out.withColumnRenamed("auc", f"auc_at_{horizon}")


def f1_at_horizon(
    df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, horizon: int, *, bound: int | None = None
) -> DataFrame:
    """F1 when risks at or above the key's exact median count as failures; null with one class."""
    rows = usable_at(df, time, event, horizon)
    cut = exact_quantiles(rows, keys, risk, {"_cut": 0.5}, bound=bound)
    y, yhat = F.col("failed") == 1, F.col(risk) >= F.col("_cut")
    cells = join_same(rows, cut, keys).groupBy(*keys).agg(
        F.count_if(y & yhat).alias("_tp"),
        F.count_if(~y & yhat).alias("_fp"),
        F.count_if(y & ~yhat).alias("_fn"),
        F.count_if(y).alias("_p"),
        F.count_if(~y).alias("_q"),
    )
    f1 = ratio_or_zero(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return cells.select(
        *keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), f1).alias(f"f1_at_{horizon}")
    )


def horizon_metrics(
    df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str, horizons: Sequence[int], *, bound: int | None = None
) -> DataFrame:
    """``auc_at_horizon`` and ``f1_at_horizon`` of every horizon from one pass over ``df``.

    Rows are combined per distinct risk with the failed and the surviving of each horizon as columns; the
    risks are put in order once. The median is where half of a horizon's rows lie below, so the running counts
    give the cut and the cells of the confusion table together.
    """
    t = F.col(time)
    counts = {}
    for n in horizons:
        counts |= {f"_p{n}": F.count_if(_is(event) & (t <= n)), f"_q{n}": F.count_if(t > n)}
    cells = df.groupBy(*keys, F.col(risk).cast("double").alias("_s")).agg(*[c.alias(name) for name, c in counts.items()])
    known = F.col("_s").isNotNull()
    sums, sizes = {}, {}
    for n in horizons:
        p, q = (F.when(known, F.col(f"_{c}{n}")).otherwise(0) for c in "pq")
        sums |= {f"_below{n}": F.col(f"_q{n}"), f"_cp{n}": p, f"_cq{n}": q}
        sizes[f"_n{n}"] = F.sum(p + q)
    rows = arrange(cells, keys, ["_s"], bound=bound).running(**sums).attach(**sizes).rows()
    parts = []
    for n in horizons:
        p, q, upto = F.col(f"_p{n}"), F.col(f"_q{n}"), F.col(f"_cp{n}") + F.col(f"_cq{n}")
        half = (F.col(f"_n{n}") - 1) * 0.5
        before = F.struct("_s", (F.col(f"_cp{n}") - p).alias("p"), (F.col(f"_cq{n}") - q).alias("q"))
        parts += [
            F.sum(p * (F.col(f"_below{n}") - q * 0.5)).alias(f"_won{n}"),
            F.sum(p).alias(f"_p{n}"),
            F.sum(q).alias(f"_q{n}"),
            F.sum(F.when(known, p)).alias(f"_kp{n}"),
            F.sum(F.when(known, q)).alias(f"_kq{n}"),
            *[F.min(F.when(known & (upto > rank), before)).alias(f"_{e}{n}") for e, rank in (("lo", F.floor(half)), ("hi", F.ceil(half)))],
        ]
    facts = rows.groupBy(*keys).agg(*parts)
    out = []
    for n in horizons:
        both = (F.col(f"_p{n}") > 0) & (F.col(f"_q{n}") > 0)
        lo, hi = F.col(f"_lo{n}"), F.col(f"_hi{n}")
        # Risks at or above the middle of the two; that is the upper one unless they are the same.
        cut = F.when(lo["_s"] + (hi["_s"] - lo["_s"]) * 0.5 <= lo["_s"], lo).otherwise(hi)
        tp, fp, fn = F.col(f"_kp{n}") - cut["p"], F.col(f"_kq{n}") - cut["q"], cut["p"]
        out += [
            F.when(both, F.col(f"_won{n}") / (F.col(f"_p{n}") * F.col(f"_q{n}"))).alias(f"auc_at_{n}"),
            F.when(both & lo.isNotNull(), ratio_or_zero(2 * tp, 2 * tp + fp + fn)).alias(f"f1_at_{n}"),
        ]
    return facts.select(*keys, *out)


def dynamic_auc(
    train: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    time: str,
    event: str,
    risk: str,
    horizon: int,
    *,
    bound: int | None = None,
) -> DataFrame:
    """Cumulative/dynamic AUC at the horizon: failures weighted by 1 / P(not censored at their time).

    The censoring curve comes from the training rows. Failures whose weight is not defined are dropped.
    """
    wanted = test.where(_is(event)).select(*keys, time).distinct()
    curve = survival_curve(
        train, keys, time, event, censoring=True, extra_times=wanted, bound=bound
    ).select(*keys, F.col("time").alias(time), F.col("survival").alias("_g"))
    rows = join_on(test, curve, [*keys, time], "left")
    failed = _is(event) & (F.col(time) <= horizon)
    rows = rows.where((failed & (F.col("_g") > 0)) | (F.col(time) > horizon)).withColumn(
        "failed", failed.cast("int")
    )
    counts = score_counts(rows, keys, "failed", risk, weight=1.0 / F.when(F.col("failed") == 1, F.col("_g")))
    return auc_from_counts(counts, keys, bound=bound).withColumnRenamed("auc", f"dynamic_auc_{horizon}")


def survival_metrics(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    event: str,
    risk: str,
    horizons: Sequence[int] = (200, 300, 400),
    *,
    bound: int | None = None,
) -> DataFrame:
    """n, events, concordance, and AUC and F1 at each horizon, per key."""
    out = concordance(df, keys, time, event, risk, bound=bound)
    return join_same(out, horizon_metrics(df, keys, time, event, risk, horizons, bound=bound), keys, "left")
