"""Queries that run the composed reports: outliers, steps, jump audit, production table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.functions import roles
from lifecurve.operators.detectors import JumpRule, OutlierRule
from lifecurve.plans import build, curation, models
from lifecurve.queries.common import CYC, HORIZONS, cycles, r6
from lifecurve.queries.curve_queries import samples
from lifecurve.queries.label_stack import LABELS, WINDOW_ROWS, cell_inputs, label_rows
from lifecurve.queries.registry import query
from lifecurve.queries.series import lts_sql

# A user's regimes are the weeks; boundaries after each week but the last.
BOUNDS = """wk AS (SELECT user_id, least(day(ts) // 7, 4) AS pos, count(*) AS n FROM events GROUP BY 1, 2),
bd AS (SELECT user_id, boundary FROM (SELECT user_id, pos, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS boundary, max(pos) OVER (PARTITION BY user_id) AS lp FROM wk) WHERE pos < lp),
nr AS (SELECT DISTINCT c.user_id, c.cycle FROM cyc c JOIN bd b ON c.user_id = b.user_id AND abs(c.cycle - b.boundary) <= 2)"""


def week_boundaries(t):
    from lifecurve.operators.series import regime_boundaries

    weeks = t.events.groupBy("user_id", F.least(F.floor(F.dayofmonth("ts") / 7), F.lit(4)).alias("pos")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return regime_boundaries(weeks, "user_id", "pos", "n", bound=t.rows("events"))


def smooth_curves(t):
    """Running mean of the values in whole millionths: exact in any engine, calm enough for the rules."""
    c = cycles(t).running(_sum=F.round(F.col("value") * 100).cast("long"))
    return c.rows().select("user_id", "cycle", F.floor(F.col("_sum") * 10000 / F.col("cycle")).cast("double").alias("level"))


SMOOTH = "ret AS (SELECT user_id, cycle, level, level / first_value(level) OVER (PARTITION BY user_id ORDER BY cycle) AS retention FROM (SELECT user_id, cycle, floor(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) * 10000 / cycle)::DOUBLE AS level FROM cyc))"

SIDE_SQL = lts_sql("pre", "-") + "," + lts_sql("post", "+")
REPORT = (
    CYC
    + ","
    + BOUNDS
    + ", r0 AS (SELECT 1), "
    + SMOOTH
    + """, subs(k, a, b, c) AS (VALUES (0,1,2,3),(1,1,2,4),(2,1,2,5),(3,1,3,4),(4,1,3,5),(5,1,4,5),(6,2,3,4),(7,2,3,5),(8,2,4,5),(9,3,4,5)),
"""
    # Neighbours near a boundary are not used.
    + SIDE_SQL.replace(
        "p.cycle = a.cycle - n.d)", "p.cycle = a.cycle - n.d WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.user_id = p.user_id AND nr.cycle = p.cycle))"
    ).replace("p.cycle = a.cycle + n.d)", "p.cycle = a.cycle + n.d WHERE NOT EXISTS (SELECT 1 FROM nr WHERE nr.user_id = p.user_id AND nr.cycle = p.cycle))")
    + """,
  tested AS (SELECT r.user_id, r.cycle, r.retention, coalesce((a.at + b.at) * 0.5, a.at) AS predicted, r.retention - coalesce((a.at + b.at) * 0.5, a.at) AS residual
      FROM ret r JOIN pre_best a ON r.user_id = a.user_id AND r.cycle = a.cycle LEFT JOIN post_best b ON r.user_id = b.user_id AND r.cycle = b.cycle
      WHERE (b.at IS NULL OR abs(a.at - b.at) <= 0.5) AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.user_id = r.user_id AND nr.cycle = r.cycle)),
  med AS (SELECT user_id, median(residual) AS med FROM tested GROUP BY 1),
  scale AS (SELECT t.user_id, any_value(m.med) AS med, median(abs(t.residual - m.med)) AS mad FROM tested t JOIN med m USING (user_id) GROUP BY 1),
  found AS (SELECT t.user_id, t.cycle AS outlier_cycle, t.residual FROM tested t JOIN scale s USING (user_id) WHERE abs(t.residual - s.med) > 4 * greatest(1.4826 * s.mad, 0.005)),
  users AS (SELECT user_id, max(cycle) AS n_regulars FROM cyc GROUP BY 1)
"""
)
RULE = OutlierRule(discontinuity_max=0.5)


def outlier_rows(t):
    header = t.events.select("user_id").distinct()
    return curation.outlier_report(
        header, smooth_curves(t), week_boundaries(t), entity="user_id", cycle="cycle", value="level", rule=RULE, bound=t.rows("events")
    )


@query(
    "outlier_report",
    "WITH " + REPORT + """SELECT u.user_id, n_regulars, coalesce(c.n, 0) AS n_outliers, f.outlier_cycle, round(f.residual, 4) AS residual, CASE WHEN f.outlier_cycle IS NOT NULL THEN false END AS near_regime_boundary
    FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM found GROUP BY 1) c USING (user_id) LEFT JOIN found f USING (user_id)""",
)
def outlier_report(t):
    return outlier_rows(t).select(
        "user_id", "n_regulars", "n_outliers", "outlier_cycle", F.round("residual", 4).alias("residual"), "near_regime_boundary"
    )


def step_sql(bump: float, persist: float, mask: str) -> str:
    return f""", src AS (SELECT ret.* FROM ret {mask}),
    fit AS (SELECT *, lag(retention) OVER w AS prev, regr_slope(retention, cycle) OVER p AS m, regr_intercept(retention, cycle) OVER p AS b, count(retention) OVER p AS pre_n,
       list(retention) OVER q AS ys, list(cycle) OVER q AS xs FROM src WINDOW w AS (PARTITION BY user_id ORDER BY cycle),
       p AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    cand AS (SELECT *, retention - prev AS mag, len(ys) AS post_n FROM fit WHERE abs(retention - prev) >= {bump}),
    res AS (SELECT c.user_id, c.cycle, median(u.y - (c.m * u.x + c.b)) AS persist FROM cand c, LATERAL (SELECT unnest(c.ys) AS y, unnest(c.xs) AS x) u GROUP BY 1, 2),
    jump AS (SELECT c.user_id, c.cycle, c.mag, r.persist, CASE WHEN c.pre_n < 10 OR c.post_n < 5 THEN 'edge_skip' WHEN abs(r.persist) >= {persist} THEN 'sustained' ELSE 'transient' END AS jump_class
      FROM cand c JOIN res r ON c.user_id = r.user_id AND c.cycle = r.cycle)"""


@query(
    "step_report",
    "WITH " + REPORT + ", " + "hd AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'signup') > 1.6 * count(*) FILTER (WHERE event_type = 'view') THEN 'rate_changed' ELSE 'single_rate' END AS cc FROM cyc GROUP BY 1)"
    + step_sql(0.02, 0.02, "JOIN hd USING (user_id) WHERE cc <> 'rate_changed' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.user_id = ret.user_id AND f.outlier_cycle = ret.cycle)")
    + """ SELECT j.user_id, j.cycle AS sustained_cycle, round(j.mag, 6) AS jump_magnitude, round(j.persist, 5) AS persistence, u.n_regulars,
      coalesce((SELECT count(*) FROM found f WHERE f.user_id = j.user_id), 0) AS n_outliers_masked, EXISTS (SELECT 1 FROM nr WHERE nr.user_id = j.user_id AND nr.cycle = j.cycle) AS near_regime_boundary
    FROM jump j JOIN users u USING (user_id) WHERE jump_class = 'sustained'""",
)
def step_report(t):
    cells = cell_inputs(t)[0].select("user_id", "cycling_consistency")
    header = cells.withColumn(
        "cycling_consistency", F.when(F.col("cycling_consistency") == "rate_changed", "rate_changed").otherwise("single_rate")
    )
    out = curation.step_report(
        header,
        smooth_curves(t),
        week_boundaries(t),
        outlier_rows(t),
        entity="user_id",
        cycle="cycle",
        value="level",
        rule=JumpRule(bump_min=0.02, persist_min=0.02),
        bound=t.rows("events"),
    )
    return out.select(
        "user_id",
        "sustained_cycle",
        r6(F.col("jump_magnitude"), "jump_magnitude"),
        F.round("persistence", 5).alias("persistence"),
        "n_regulars",
        "n_outliers_masked",
        "near_regime_boundary",
    )


@query(
    "jump_class_rollup",
    "WITH " + REPORT + step_sql(0.03, 0.03, "") + """, b AS (SELECT user_id, max(CASE jump_class WHEN 'sustained' THEN 3 WHEN 'transient' THEN 2 ELSE 1 END) AS r, min(cycle) FILTER (WHERE jump_class = 'sustained') AS fs FROM jump GROUP BY 1),
    v AS (SELECT u.user_id, CASE coalesce(r, 0) WHEN 3 THEN 'sustained' WHEN 2 THEN 'transient' WHEN 1 THEN 'edge_skip' ELSE 'none' END AS strongest, fs,
      CASE WHEN fs IS NOT NULL THEN EXISTS (SELECT 1 FROM nr WHERE nr.user_id = u.user_id AND nr.cycle = fs) END AS ab FROM users u LEFT JOIN b USING (user_id))
    SELECT strongest, count(*) AS n, count(*) FILTER (WHERE ab) AS n_at_boundary, round(count(*) FILTER (WHERE ab) / nullif(count(ab), 0), 6) AS share_at_boundary FROM v GROUP BY 1""",
)
def jump_class_rollup(t):
    _, verdict = curation.jump_audit(
        smooth_curves(t),
        week_boundaries(t),
        t.events.select("user_id").distinct(),
        entity="user_id",
        cycle="cycle",
        value="level",
        bound=t.rows("events"),
    )
    out = curation.boundary_coincidence(verdict)
    return out.withColumn("share_at_boundary", F.round("share_at_boundary", 6))


# Pass probability per seed: event types vote with the share of their values above a level that grows with the horizon.
@query(
    "production_table",
    "WITH " + LABELS + "," + ",".join(
        f"""p{n} AS (SELECT user_id, avg(p) AS m, stddev_pop(p) AS s FROM (SELECT user_id, event_type, avg(CAST(value > {n} AS DOUBLE)) AS p FROM events GROUP BY 1, 2) GROUP BY 1)"""
        for n in HORIZONS
    )
    + "SELECT lab.user_id, status, n_regular, "
    + ", ".join(
        f"""round(p{n}.m, 6) AS prob_pass_n{n}, round(p{n}.s, 6) AS prob_pass_n{n}_std, CAST(round(p{n}.m, 9) >= 0.5 AS INT) AS pass_n{n},
        CASE WHEN status = 'excluded' THEN NULL WHEN status = 'faded' THEN CAST(last_fade_cycle >= {n} AS DOUBLE) WHEN n_regular >= {n} THEN 1.0::DOUBLE END AS true_pass_n{n}"""
        for n in HORIZONS
    )
    + " FROM lab " + " ".join(f"JOIN p{n} USING (user_id)" for n in HORIZONS),
)
def production_table(t):
    scores = {
        n: t.events.groupBy("user_id", F.col("event_type").alias("seed")).agg(
            F.avg((F.col("value") > n).cast("double")).alias("proba")
        )
        for n in HORIZONS
    }
    out = models.production_table(label_rows(t), scores, entity="user_id")
    rounded = [c for c in out.columns if c.startswith("prob_")]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "feature_build",
    "WITH " + WINDOW_ROWS + """,
    ta AS (SELECT user_id, arg_max(ce, cycle) * 100 AS ce_final, arg_max(dis, cycle) / max(bd) AS dis_final, min(chg) / max(bc) AS chg_min FROM w GROUP BY 1),
    sm AS (SELECT e.user_id, w.cycle, CASE WHEN event_type IN ('view', 'click') THEN 'charge' ELSE 'discharge' END AS phase, event_id, epoch(ts) AS t, value AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v
      FROM events e JOIN w ON w.user_id = e.user_id AND w.cycle = least(day(ts) // 7, 4) + 1),
    sg AS (SELECT *, (i + lag(i) OVER o) / 2 * (t - lag(t) OVER o) AS q, (v * i + lag(v * i) OVER o) / 2 * (t - lag(t) OVER o) AS e FROM sm WINDOW o AS (PARTITION BY user_id, cycle, phase ORDER BY t, event_id)),
    nl AS (SELECT user_id, cycle, phase, CASE WHEN count(*) >= 2 AND abs(sum(q)) >= 1e-12 THEN abs(sum(e)) / abs(sum(q)) END AS nom FROM sg GROUP BY 1, 2, 3),
    nw AS (SELECT w.user_id, w.cycle, max(nom) FILTER (WHERE phase = 'charge') AS c, max(nom) FILTER (WHERE phase = 'discharge') AS d FROM w LEFT JOIN nl ON nl.user_id = w.user_id AND nl.cycle = w.cycle GROUP BY 1, 2),
    tb AS (SELECT user_id, count(*) >= 2 AND bool_and(c IS NOT NULL AND d IS NOT NULL) AND arg_min(c, cycle) > 0 AND arg_min(d, cycle) > 0 AS ok, arg_min(c, cycle) AS c0, arg_min(d, cycle) AS d0, max(d) AS dm, stddev_samp(d) AS ds, max(c) AS cm FROM nw GROUP BY 1)
    SELECT user_id AS cell_name, round(ce_final, 6) AS coulombic_efficiency_final, round(dis_final, 6) AS discharge_capacity_retention_final, round(chg_min, 6) AS charge_capacity_retention_min,
      round(CASE WHEN ok THEN dm / d0 END, 6) AS discharge_nominal_voltage_retention_max, round(CASE WHEN ok THEN ds / d0 END, 6) AS discharge_nominal_voltage_retention_std,
      round(CASE WHEN ok THEN cm / c0 END, 6) AS charge_nominal_voltage_retention_max, CAST(0 AS BIGINT) AS n_fits, CAST(3 AS BIGINT) AS n_without_fit FROM ta JOIN tb USING (user_id)""",
)
def feature_build(t):
    """From measurements and samples to the feature row of every eligible cell; the weeks' events are the slices' samples.

    No plateau is there to fit, so the status names all three fits as missing (``decay_grid_fit`` has the fits).
    """
    cells, meas, _, _ = cell_inputs(t)
    names = {"user_id": "cell_name", "cycle": "regular_cycle", "dis": "capacity_discharge_ah", "chg": "capacity_charge_ah", "ce": "coulombic_efficiency"}
    cells, cycles = cells.withColumnRenamed("user_id", "cell_name"), meas.withColumnsRenamed(names).withColumn("cd_index", F.col("regular_cycle"))
    phase = F.when(F.col("phase").isin("view", "click"), "charge").otherwise("discharge")
    week = (F.least(F.floor(F.col("day") / 7), F.lit(4)) + 1).alias("cd_index")
    rows = samples(t).select(F.col("user_id").alias("cell_name"), week, phase.alias("cd_phase"), F.col("t").alias("elapsed_time"), F.col("i").alias("current"), F.col("v").alias("voltage"))
    plateau = rows.where("false").select("cell_name", "cd_index", F.col("elapsed_time").alias("t_s"), "current")
    features, status = build.feature_tables(cells, cycles, rows, plateau, baseline_cycle=2, bound=t.rows("events"))
    fits = status.groupBy("cell_name").agg(F.count_if("success").alias("n_fits"), F.count_if(~F.col("success")).alias("n_without_fit"))
    out = features.join(fits, "cell_name")
    return out.select("cell_name", *[F.round(c, 6).alias(c) for c in (*roles.TIER_A, *roles.TIER_B)], "n_fits", "n_without_fit")
