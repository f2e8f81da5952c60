"""Queries of the label and feature-gate stack, on event histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.functions import roles
from lifecurve.functions.scalars import cohort_three_way, cohort_two_way, prefix_cohort
from lifecurve.operators import labels
from lifecurve.operators.ordered import arrange
from lifecurve.queries.common import CYC, HORIZONS, cycles, r6
from lifecurve.queries.registry import query
from lifecurve.queries.series import FADE, fade_table

# Users are cells. All cell facts follow from the content of their events.
CELLS = (
    CYC
    + """,
cells AS (SELECT user_id,
    CASE WHEN count(*) FILTER (WHERE event_type = 'signup') > 1.6 * count(*) FILTER (WHERE event_type = 'view') THEN 'rate_changed'
         WHEN count(*) FILTER (WHERE event_type = 'error') > 0.30 * count(*) THEN 'no_regular' ELSE 'single_rate' END AS cycling_consistency,
    arg_max(event_type, cycle) AS protocol_pattern,
    count(*) FILTER (WHERE event_type = 'click') AS first_regime_n FROM cyc GROUP BY user_id),
decisions AS (SELECT user_id, arg_max(event_type, cycle) = 'error' AS exclude_from_ml,
    max(cycle) FILTER (WHERE event_type = 'purchase') AS last_available_cycle,
    CASE arg_min(event_type, cycle) WHEN 'click' THEN 'event' WHEN 'view' THEN 'censor' END AS event_type
    FROM cyc GROUP BY user_id
    HAVING count(*) FILTER (WHERE event_type = 'purchase') > count(*) FILTER (WHERE event_type = 'click')),
outl AS (SELECT user_id, cycle FROM cyc WHERE k >= 95),
meas AS (SELECT user_id, cycle, value AS dis, value * (1 + k / 1000.0) AS chg, 0.9 + k / 1000.0 AS ce, event_type, k FROM cyc)
"""
)

LABELS = (
    CELLS
    + """,
b0 AS (SELECT user_id, dis AS base FROM meas WHERE cycle = 1),
facts AS (SELECT m.user_id, max(m.cycle) AS n_full, any_value(b0.base) AS base,
    bool_or(m.cycle <= 5 AND (m.dis < 0.1 OR m.chg < 0.1)) AS low,
    arg_max(m.dis, m.cycle) FILTER (WHERE d.last_available_cycle IS NULL OR m.cycle <= d.last_available_cycle) AS at_target,
    count(*) FILTER (WHERE o.cycle IS NULL AND (d.last_available_cycle IS NULL OR m.cycle <= d.last_available_cycle)) AS n_window,
    count(*) FILTER (WHERE o.cycle IS NOT NULL AND (d.last_available_cycle IS NULL OR m.cycle <= d.last_available_cycle)) AS n_masked
  FROM meas m LEFT JOIN b0 USING (user_id) LEFT JOIN decisions d USING (user_id)
  LEFT JOIN outl o ON o.user_id = m.user_id AND o.cycle = m.cycle GROUP BY m.user_id),
curve AS (SELECT m.user_id, m.cycle, m.dis / b0.base AS r FROM meas m JOIN b0 USING (user_id) LEFT JOIN decisions d USING (user_id)
  WHERE b0.base > 0 AND (d.last_available_cycle IS NULL OR m.cycle <= d.last_available_cycle)
    AND NOT EXISTS (SELECT 1 FROM outl o WHERE o.user_id = m.user_id AND o.cycle = m.cycle)),
cr AS (SELECT *, r < 0.85 AND coalesce(lag(r) OVER (PARTITION BY user_id ORDER BY cycle), 0.85) >= 0.85 AS x,
   coalesce(sum(CASE WHEN r > 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ok
   FROM curve),
fd AS (SELECT user_id, max(cycle) FILTER (WHERE x AND ok < 3) AS lf, count(*) FILTER (WHERE x AND ok >= 3) AS nr, arg_max(r, cycle) AS fr FROM cr GROUP BY 1),
gate AS (SELECT c.*, f.*, fd.lf, fd.nr, fd.fr, d.exclude_from_ml, d.last_available_cycle AS lac, d.event_type AS et,
   CASE WHEN c.cycling_consistency = 'rate_changed' THEN 'rate_changed' WHEN c.cycling_consistency = 'no_regular' THEN 'no_regular'
     WHEN d.exclude_from_ml THEN 'human_review' WHEN f.low THEN 'low_initial_capacity' WHEN NOT f.base > 0 THEN 'no_baseline'
     WHEN d.event_type IS NULL AND f.n_window = 0 THEN 'no_baseline' END AS reason
   FROM cells c LEFT JOIN facts f USING (user_id) LEFT JOIN fd USING (user_id) LEFT JOIN decisions d USING (user_id)),
lab AS (SELECT user_id, CASE WHEN CAST(user_id AS VARCHAR) LIKE '0MC%' THEN '0MC' ELSE 'AR' END AS cohort, protocol_pattern, cycling_consistency,
   CASE WHEN cycling_consistency = 'rate_changed' THEN first_regime_n END AS n_regular_pre_rate_change,
   CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN et = 'event' THEN 'faded' WHEN et = 'censor' THEN 'in_testing'
        WHEN lf IS NOT NULL THEN 'faded' ELSE 'in_testing' END AS status,
   reason AS exclusion_reason,
   CASE WHEN reason IS NULL THEN CASE WHEN et = 'event' THEN coalesce(lac, n_full) WHEN et = 'censor' THEN NULL ELSE lf END END AS last_fade_cycle,
   CASE WHEN reason IS NULL AND et IS NOT NULL THEN coalesce(lac, n_full) WHEN reason IS NULL THEN least(n_full, coalesce(lac, n_full))
        WHEN reason = 'rate_changed' AND first_regime_n >= 5 AND base > 0 THEN n_full ELSE 0 END AS n_regular,
   CASE WHEN reason IS NULL OR (reason = 'rate_changed' AND first_regime_n >= 5 AND base > 0) THEN base END AS baseline_dis_ah,
   round(CASE WHEN reason IS NULL AND et IS NOT NULL THEN at_target / base WHEN reason IS NULL THEN fr END, 6) AS final_retention,
   CASE WHEN reason IS NULL AND et IS NULL THEN nr ELSE 0 END AS n_recovered_crossings,
   CASE WHEN reason IS NULL THEN lac END AS truncation_cycle,
   CASE WHEN reason IS NULL AND et IS NULL THEN n_masked ELSE 0 END AS n_outliers_masked FROM gate)
"""
)


def horizon_sql(n: int, status="status", fade="last_fade_cycle", n_regular="n_regular") -> str:
    label = (
        f"CASE WHEN {status} = 'faded' THEN CASE WHEN {fade} > {n} THEN 'pass' ELSE 'bad' END "
        f"WHEN {status} = 'in_testing' THEN CASE WHEN {n_regular} >= {n} THEN 'pass' ELSE 'censor' END ELSE 'excluded' END"
    )
    return f"{label} AS label_n{n}, {label} IN ('pass', 'bad') AS trainable_n{n}"


LABEL_HORIZONS = ", ".join(horizon_sql(n) for n in HORIZONS)


def cell_inputs(t):
    """(cells, measurements, decisions, outliers) read from the events."""
    return inputs_of(cycles(t, "event_type", "k").rows(), "user_id")


def inputs_of(c, entity):
    """The same from rows (entity, cycle, event_type, value, k)."""

    def n(kind):
        return F.count_if(F.col("event_type") == kind)

    per_user = c.groupBy(entity).agg(
        n("signup").alias("signup"),
        n("view").alias("view"),
        n("error").alias("error"),
        n("purchase").alias("purchase"),
        n("click").alias("first_regime_n"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("event_type", "cycle").alias("last_type"),
        F.min_by("event_type", "cycle").alias("first_type"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("cycle"))).alias("last_available_cycle"),
    )
    cells = per_user.select(
        entity,
        F.when(F.col("signup") > 1.6 * F.col("view"), "rate_changed")
        .when(F.col("error") > 0.30 * F.col("n"), "no_regular")
        .otherwise("single_rate")
        .alias("cycling_consistency"),
        F.col("last_type").alias("protocol_pattern"),
        "first_regime_n",
    )
    decisions = per_user.where("purchase > first_regime_n").select(
        entity,
        (F.col("last_type") == "error").alias("exclude_from_ml"),
        "last_available_cycle",
        F.when(F.col("first_type") == "click", "event")
        .when(F.col("first_type") == "view", "censor")
        .alias("event_type"),
    )
    outliers = c.where("k >= 95").select(entity, "cycle")
    meas = c.select(
        entity,
        "cycle",
        F.col("value").alias("dis"),
        (F.col("value") * (1 + F.col("k") / 1000.0)).alias("chg"),
        (0.9 + F.col("k") / 1000.0).alias("ce"),
        "event_type",
        "k",
    )
    return cells, meas, decisions, outliers


def label_rows(t):
    cells, meas, decisions, outliers = cell_inputs(t)
    out = labels.build_labels(
        cells,
        meas,
        entity="user_id",
        cycle="cycle",
        discharge="dis",
        charge="chg",
        decisions=decisions,
        outliers=outliers,
        horizons=HORIZONS,
        cohort=cohort_two_way(F.col("user_id").cast("string")),
        bound=t.rows("events"),
    )
    return out.withColumn("final_retention", F.round("final_retention", 6))


@query("label_build", "WITH " + LABELS + f"SELECT *, {LABEL_HORIZONS} FROM lab")
def label_build(t):
    return label_rows(t)


@query("exclusion_cascade", "WITH " + LABELS + "SELECT user_id, status, exclusion_reason, n_regular, baseline_dis_ah FROM lab WHERE exclusion_reason IS NOT NULL")
def exclusion_cascade(t):
    return label_rows(t).where("exclusion_reason is not null").select(
        "user_id", "status", "exclusion_reason", "n_regular", "baseline_dis_ah"
    )


@query("human_override", "WITH " + LABELS + "SELECT l.user_id, status, last_fade_cycle, n_regular, final_retention, truncation_cycle FROM lab l JOIN decisions d USING (user_id) WHERE d.event_type IS NOT NULL AND exclusion_reason IS NULL")
def human_override(t):
    decisions = cell_inputs(t)[2].where("event_type is not null").select("user_id")
    return label_rows(t).where("exclusion_reason is null").join(decisions, "user_id", "left_semi").select(
        "user_id", "status", "last_fade_cycle", "n_regular", "final_retention", "truncation_cycle"
    )


@query("masked_fade", "WITH " + LABELS + "SELECT user_id, last_fade_cycle, n_recovered_crossings, n_outliers_masked FROM lab WHERE n_outliers_masked > 0")
def masked_fade(t):
    return label_rows(t).where("n_outliers_masked > 0").select(
        "user_id", "last_fade_cycle", "n_recovered_crossings", "n_outliers_masked"
    )


@query("status_histogram", "WITH " + LABELS + "SELECT status, coalesce(exclusion_reason, '-') AS reason, count(*) AS n FROM lab GROUP BY 1, 2")
def status_histogram(t):
    return (
        label_rows(t)
        .groupBy("status", F.coalesce("exclusion_reason", F.lit("-")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fade_status(t):
    """Status table from the fade rule alone."""
    return fade_table(t).select(
        "user_id",
        F.when(F.col("last_fade").isNotNull(), "faded").otherwise("in_testing").alias("status"),
        F.col("last_fade").alias("last_fade_cycle"),
        F.col("last_cycle").alias("n_regular"),
        "n_recovered",
        "final_retention",
    )


STATUS = (
    FADE
    + """,
st AS (SELECT user_id, CASE WHEN last_fade IS NOT NULL THEN 'faded' ELSE 'in_testing' END AS status,
   last_fade AS last_fade_cycle, last_cycle AS n_regular FROM fade)
"""
)


@query("fade_status", "WITH " + STATUS + "SELECT status, count(*) AS n, CAST(sum(n_regular) AS BIGINT) AS cycles FROM st GROUP BY 1")
def fade_status_counts(t):
    return fade_status(t).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_regular").alias("cycles")
    )


@query("horizon_labels", "WITH " + STATUS + f"SELECT user_id, status, last_fade_cycle, n_regular, {LABEL_HORIZONS} FROM st")
def horizon_labels(t):
    out = labels.with_horizon_labels(fade_status(t), HORIZONS)
    return out.drop("n_recovered", "final_retention")


@query("true_pass", "WITH " + LABELS + "SELECT user_id, " + ", ".join(
    f"CASE WHEN status = 'excluded' THEN NULL WHEN status = 'faded' THEN CASE WHEN last_fade_cycle >= {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n_regular >= {n} THEN 1.0::DOUBLE END AS true_pass_n{n}"
    for n in HORIZONS) + " FROM lab")
def true_pass(t):
    return label_rows(t).select(
        "user_id",
        *[
            labels.true_pass(F.col("status"), F.col("last_fade_cycle"), F.col("n_regular"), n).alias(f"true_pass_n{n}")
            for n in HORIZONS
        ],
    )


@query("low_initial_gate", "WITH " + CELLS + "SELECT user_id, bool_or(cycle <= 5 AND (dis < 0.1 OR chg < 0.1)) AS low_initial FROM meas GROUP BY 1")
def low_initial_gate(t):
    _, meas, _, _ = cell_inputs(t)
    o = arrange(meas, ["user_id"], ["cycle"], bound=t.rows("events")).position("pos")
    return labels.low_initial(o, "user_id", "pos", ["dis", "chg"])


WINDOW_ROWS = (
    CELLS
    + """,
w AS (SELECT m.user_id, m.cycle, m.dis, m.chg, m.ce, b.dis AS bd, b.chg AS bc FROM meas m
   JOIN cells c ON c.user_id = m.user_id AND (c.cycling_consistency = 'single_rate' OR (c.cycling_consistency = 'rate_changed' AND c.first_regime_n >= 5))
   JOIN meas b ON b.user_id = m.user_id AND b.cycle = 2
   WHERE m.cycle BETWEEN 2 AND 5 AND b.dis > 0 AND b.chg > 0
     AND (SELECT count(*) FROM meas q WHERE q.user_id = m.user_id AND q.cycle <= 5) = 5)
"""
)


def window_rows(t):
    cells, meas, _, _ = cell_inputs(t)
    return labels.feature_window(
        cells,
        meas,
        entity="user_id",
        cycle="cycle",
        discharge="dis",
        charge="chg",
        efficiency="ce",
        baseline_cycle=2,
        bound=t.rows("events"),
    )


@query("eligibility_gate", "WITH " + WINDOW_ROWS + "SELECT user_id, cycle, dis, bd AS baseline_discharge, round(bc, 6) AS baseline_charge FROM w")
def eligibility_gate(t):
    return window_rows(t).select(
        "user_id", "cycle", "dis", "baseline_discharge", r6(F.col("baseline_charge"), "baseline_charge")
    )


@query(
    "tier_a_scalars",
    "WITH " + WINDOW_ROWS + """SELECT user_id, round(arg_max(ce, cycle) * 100, 6) AS coulombic_efficiency_final,
      round(arg_max(dis, cycle) / max(bd), 6) AS discharge_capacity_retention_final,
      round(min(chg) / max(bc), 6) AS charge_capacity_retention_min FROM w GROUP BY 1""",
)
def tier_a_scalars(t):
    out = labels.tier_a(window_rows(t), entity="user_id", cycle="cycle", discharge="dis", charge="chg", efficiency="ce")
    return out.select("user_id", *[r6(F.col(c), c) for c in roles.TIER_A])


LEARN = (
    LABELS
    + """,
feat AS (SELECT user_id, avg(k) AS mean_k, max(value) AS top_value FROM cyc GROUP BY 1),
lt AS (SELECT *, label_n60 = 'pass' AS ok60 FROM (SELECT *, """
    + LABEL_HORIZONS
    + """ FROM lab) JOIN feat USING (user_id))
"""
)


def feature_rows(t):
    return cycles(t, "k").rows().groupBy("user_id").agg(F.avg("k").alias("mean_k"), F.max("value").alias("top_value"))


@query(
    "task_masks",
    "WITH " + LEARN + """SELECT user_id, round(mean_k, 6) AS mean_k, top_value, status = 'faded' AS event,
      CASE WHEN status = 'faded' THEN last_fade_cycle ELSE n_regular END AS time,
      CASE WHEN status = 'faded' THEN CAST(last_fade_cycle AS DOUBLE) END AS y_cycle, CAST(ok60 AS INT) AS y_class,
      trainable_n60 AS mask_classification, status = 'faded' AS mask_regression, status <> 'excluded' AS mask_survival,
      n_regular >= 6 AND status <> 'excluded' AS may_train, n_regular >= 5 AS may_score FROM lt""",
)
def task_masks(t):
    df = labels.learning_table(label_rows(t), feature_rows(t), 60, entity="user_id", drop_excluded=False)
    df = labels.train_and_score_masks(df)
    masks = ["mask_classification", "mask_regression", "mask_survival", "may_train", "may_score"]
    return df.select(
        "user_id", r6(F.col("mean_k"), "mean_k"), "top_value", "event", "time", "y_cycle", "y_class", *masks
    )


@query(
    "kept_learning_rows",
    "WITH " + LEARN + "SELECT user_id, status, n_regular, label_n60 FROM lt WHERE status <> 'excluded' AND n_regular >= 6",
)
def kept_learning_rows(t):
    df = labels.learning_table(label_rows(t), feature_rows(t), 60, entity="user_id", min_n_regular=6)
    return df.select("user_id", "status", "n_regular", "label_n60")


@query(
    "survival_targets",
    "WITH " + STATUS + """SELECT user_id, status = 'faded' AS event, CASE WHEN status = 'faded' THEN last_fade_cycle ELSE n_regular END AS time FROM st""",
)
def survival_targets(t):
    event = F.col("status") == "faded"
    return fade_status(t).select(
        "user_id", event.alias("event"), F.when(event, F.col("last_fade_cycle")).otherwise(F.col("n_regular")).alias("time")
    )


@query(
    "prefix_cohorts",
    """SELECT p_partkey, CASE WHEN p_name LIKE '0MC%' THEN '0MC' ELSE 'AR' END AS two_way,
      CASE WHEN p_name LIKE 'AR%' THEN 'AR' WHEN p_name LIKE '0MC2%' THEN '0MC2' ELSE 'other' END AS three_way,
      CASE WHEN p_name LIKE 'small%' THEN 'S' WHEN p_name LIKE 'red%' THEN 'R' ELSE 'rest' END AS by_name FROM part""",
)
def prefix_cohorts(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        cohort_two_way(name).alias("two_way"),
        cohort_three_way(name).alias("three_way"),
        prefix_cohort(name, [("small", "S"), ("red", "R")], "rest").alias("by_name"),
    )


@query(
    "role_projection",
    """SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation_code FROM supplier""",
)
def role_projection(t):
    table_roles = {"s_suppkey": "meta", "s_name": "meta", "s_acctbal": "feature", "nation_code": "feature", "s_nationkey": "label"}
    df = t.supplier.withColumn("nation_code", F.col("s_nationkey").cast("double"))
    wanted = roles.subset_columns("fs_all", table_roles)
    return roles.training_matrix(df, ["s_suppkey"], wanted, table_roles)
