"""Queries on ordered series: fade, as-of lookups, trends, steps and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.operators import detectors, series
from lifecurve.queries.common import CYC, HORIZONS, RET, cycles, r6, retentions
from lifecurve.queries.registry import query

FADE = (
    RET
    + """,
cross_rows AS (
  SELECT *, retention < 0.85 AND coalesce(lag(retention) OVER w, 0.85) >= 0.85 AS crossing,
         coalesce(sum(CASE WHEN retention > 0.85 THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after_ok
  FROM ret WINDOW w AS (PARTITION BY user_id ORDER BY cycle)),
fade AS (
  SELECT user_id, count(*) AS n_obs, max(cycle) AS last_cycle,
         max(CASE WHEN crossing AND after_ok < 3 THEN cycle END) AS last_fade,
         count(CASE WHEN crossing AND after_ok >= 3 THEN 1 END) AS n_recovered,
         arg_max(retention, cycle) AS final_retention
  FROM cross_rows GROUP BY user_id)
"""
)


def fade_table(t):
    return series.sticky_fade(retentions(t), "user_id")


@query("cycle_retention", "WITH " + RET + "SELECT user_id, cycle, round(retention, 6) AS retention FROM ret")
def cycle_retention(t):
    return retentions(t).rows().select("user_id", "cycle", r6(F.col("retention"), "retention"))


@query(
    "fade_crossings",
    "WITH " + FADE + "SELECT user_id, cycle, after_ok AS healthy_after, after_ok < 3 AS sticky FROM cross_rows WHERE crossing".replace(
        "after_ok AS", "CAST(after_ok AS BIGINT) AS"
    ),
)
def fade_crossings(t):
    rows = series.fade_rows(retentions(t)).where("crossing")
    return rows.select("user_id", "cycle", "healthy_after", "sticky")


@query(
    "sticky_fade",
    "WITH " + FADE + "SELECT user_id, n_obs, last_fade, n_recovered, round(final_retention, 6) AS final_retention FROM fade",
)
def sticky_fade(t):
    return fade_table(t).select(
        "user_id", "n_obs", "last_fade", "n_recovered", r6(F.col("final_retention"), "final_retention")
    )


@query(
    "asof_forward",
    "WITH " + CYC + ",".join(
        [""]
        + [
            f"""f{n} AS (SELECT user_id, value AS value_at_n{n}, cycle AS cycle_at_n{n} FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cycle) rn FROM cyc WHERE cycle >= {n}) WHERE rn = 1)"""
            for n in HORIZONS
        ]
    )
    + "SELECT u.user_id, value_at_n50, cycle_at_n50, value_at_n60, cycle_at_n60, value_at_n70, cycle_at_n70 FROM "
    "(SELECT DISTINCT user_id FROM events) u LEFT JOIN f50 USING (user_id) LEFT JOIN f60 USING (user_id) LEFT JOIN f70 USING (user_id)",
)
def asof_forward(t):
    return series.asof_forward(cycles(t).rows(), "user_id", "cycle", "value", HORIZONS)


@query(
    "asof_backward",
    "WITH " + CYC + """, target AS (
      SELECT user_id, CAST(round(avg(k)) AS BIGINT) AS target_cycle FROM cyc GROUP BY user_id),
    hit AS (SELECT c.user_id, max(c.cycle) AS cycle_at FROM cyc c JOIN target t ON c.user_id = t.user_id AND c.cycle <= t.target_cycle GROUP BY c.user_id)
    SELECT t.user_id, t.target_cycle, h.cycle_at, c.value AS value_at FROM target t
    LEFT JOIN hit h USING (user_id) LEFT JOIN cyc c ON c.user_id = h.user_id AND c.cycle = h.cycle_at""",
)
def asof_backward(t):
    rows = cycles(t, "k").rows()
    targets = rows.groupBy("user_id").agg(F.round(F.avg("k")).cast("long").alias("target_cycle"))
    return series.asof_backward(rows, targets, "user_id", "cycle", "value", "target_cycle", bound=t.rows("events"))


@query(
    "running_min_to_n",
    "WITH " + CYC + """, stop AS (SELECT user_id,
      min(CASE WHEN cycle >= 50 THEN cycle END) s50, min(CASE WHEN cycle >= 60 THEN cycle END) s60,
      min(CASE WHEN cycle >= 70 THEN cycle END) s70 FROM cyc GROUP BY user_id)
    SELECT user_id, min(value) FILTER (WHERE s50 IS NULL OR cycle <= s50) AS min_through_n50,
      min(value) FILTER (WHERE s60 IS NULL OR cycle <= s60) AS min_through_n60,
      min(value) FILTER (WHERE s70 IS NULL OR cycle <= s70) AS min_through_n70
    FROM cyc JOIN stop USING (user_id) GROUP BY user_id""",
)
def running_min_to_n(t):
    return series.running_min_to(cycles(t).rows(), "user_id", "cycle", "value", HORIZONS, bound=t.rows("events"))


@query(
    "retention_family",
    "WITH " + CYC + """, snap AS (SELECT user_id, max(cycle) FILTER (WHERE event_type = 'purchase') AS sc FROM cyc GROUP BY user_id),
    f AS (SELECT user_id, value AS v1 FROM cyc WHERE cycle = 1),
    a AS (SELECT c.user_id, max(cycle) AS n_cycles, max(value) FILTER (WHERE cycle = 5) AS c5, arg_max(value, cycle) AS vl,
      min(value) AS vm, arg_min(value, cycle) FILTER (WHERE cycle >= 50) AS n50,
      arg_min(value, cycle) FILTER (WHERE cycle >= 60) AS n60, arg_min(value, cycle) FILTER (WHERE cycle >= 70) AS n70,
      arg_max(value, cycle) FILTER (WHERE cycle <= s.sc) AS vs
      FROM cyc c JOIN snap s ON c.user_id = s.user_id GROUP BY c.user_id)
    SELECT user_id, n_cycles, v1 AS first_value, round(c5 / v1, 6) AS ret_c5, round(vl / v1, 6) AS ret_last,
      round(vm / v1, 6) AS ret_min, round(n50 / v1, 6) AS ret_n50, round(n60 / v1, 6) AS ret_n60,
      round(n70 / v1, 6) AS ret_n70, round(vs / v1, 6) AS ret_snapshot
    FROM a JOIN f USING (user_id) WHERE v1 <> 0""",
)
def retention_family(t):
    rows = cycles(t, "event_type").rows()
    snap = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("cycle"))).alias("snapshot_cycle")
    )
    out = series.retention_family(rows, "user_id", "cycle", "value", HORIZONS, snap, bound=t.rows("events"))
    rounded = [r6(F.col(c), c) for c in out.columns if c.startswith("ret_")]
    return out.select("user_id", "n_cycles", "first_value", *rounded)


REGIMES = """
reg AS (SELECT o_custkey, year(o_orderdate) AS pos, count(*) AS n, avg(o_totalprice) AS rate FROM orders GROUP BY 1, 2),
bnd AS (SELECT o_custkey, pos, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY pos) AS BIGINT) AS boundary,
          max(pos) OVER (PARTITION BY o_custkey) AS lastpos FROM reg)
"""


def order_regimes(t):
    """A customer's orders per year read as regimes."""
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("rate")
    )


@query("regime_boundaries", "WITH " + REGIMES + "SELECT o_custkey, CAST(pos AS BIGINT) AS pos, boundary FROM bnd WHERE pos < lastpos")
def regime_boundaries(t):
    out = series.regime_boundaries(order_regimes(t), "o_custkey", "pos", "n", bound=t.rows("orders"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(
    "near_boundary",
    "WITH " + REGIMES + """, oc AS (SELECT o_custkey, o_orderkey,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS cycle FROM orders)
    SELECT o_custkey, o_orderkey, cycle, EXISTS (SELECT 1 FROM bnd b WHERE b.o_custkey = oc.o_custkey AND b.pos < b.lastpos
      AND abs(oc.cycle - b.boundary) <= 2) AS near FROM oc""",
)
def near_boundary(t):
    rows = t.rows("orders")
    o = series.number_cycles(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate"),
        "o_custkey",
        ["o_orderdate", "o_orderkey"],
        bound=rows,
    )
    cuts = series.regime_boundaries(order_regimes(t), "o_custkey", "pos", "n", bound=rows)
    return series.near_boundary(o.rows().drop("o_orderdate"), cuts, "o_custkey", "cycle")


@query(
    "rate_delta",
    "WITH " + REGIMES + """SELECT o_custkey, round(CASE WHEN count(rate) >= 2 AND min(rate) > 0
      THEN (max(rate) - min(rate)) / min(rate) * 100 END, 6) AS max_rate_delta_pct FROM reg GROUP BY 1""",
)
def rate_delta(t):
    out = series.rate_delta_pct(order_regimes(t), "o_custkey", "rate")
    return out.select("o_custkey", r6(F.col("max_rate_delta_pct"), "max_rate_delta_pct"))


TREND = (
    RET
    + """,
fit AS (SELECT *, lag(retention) OVER w AS prev,
   regr_slope(retention, cycle) OVER p AS m, regr_intercept(retention, cycle) OVER p AS b, count(retention) OVER p AS pre_n,
   list(retention) OVER q AS ys, list(cycle) OVER q AS xs
 FROM ret WINDOW w AS (PARTITION BY user_id ORDER BY cycle),
   p AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
   q AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
"""
)


@query(
    "rolling_trend",
    "WITH " + TREND + """, mean AS (SELECT user_id, cycle, pre_n, CASE WHEN pre_n < 2 THEN 0 ELSE m END AS m,
      CASE WHEN pre_n < 2 THEN lag(retention) OVER (PARTITION BY user_id ORDER BY cycle) ELSE b END AS b FROM fit)
    SELECT user_id, cycle, round(m, 6) AS pre_slope, round(b, 6) AS pre_intercept, pre_n FROM mean WHERE pre_n > 0""",
)
def rolling_trend(t):
    rows = detectors.rolling_trend(retentions(t), "cycle", "retention").rows()
    return rows.where(F.col("pre_n") > 0).select(
        "user_id", "cycle", r6(F.col("pre_slope"), "pre_slope"), r6(F.col("pre_intercept"), "pre_intercept"), "pre_n"
    )


def jump_sql(bump: float, persist: float) -> str:
    return (
        TREND
        + f""",
    cand AS (SELECT *, retention - prev AS mag, len(ys) AS post_n FROM fit WHERE abs(retention - prev) >= {bump}),
    res AS (SELECT c.user_id, c.cycle, median(u.y - (c.m * u.x + c.b)) AS persist FROM cand c,
        LATERAL (SELECT unnest(c.ys) AS y, unnest(c.xs) AS x) u GROUP BY c.user_id, c.cycle),
    jump AS (SELECT c.user_id, c.cycle AS jump_cycle, c.mag AS jump_magnitude,
        CASE WHEN c.mag > 0 THEN 'up' ELSE 'down' END AS jump_direction,
        c.pre_n, c.post_n, CASE WHEN c.pre_n < 10 OR c.post_n < 5 THEN 0 ELSE r.persist END AS persistence,
        CASE WHEN c.pre_n < 10 OR c.post_n < 5 THEN 0 ELSE c.m END AS pre_slope,
        CASE WHEN c.pre_n < 10 OR c.post_n < 5 THEN 'edge_skip'
             WHEN abs(r.persist) >= {persist} THEN 'sustained' ELSE 'transient' END AS jump_class
      FROM cand c JOIN res r ON c.user_id = r.user_id AND c.cycle = r.cycle)
    """
    )


@query(
    "jump_candidates",
    "WITH " + jump_sql(0.03, 0.03) + """SELECT user_id, jump_cycle, round(jump_magnitude, 6) AS jump_magnitude, jump_direction,
     round(pre_slope, 6) AS pre_slope, pre_n, post_n, round(persistence, 5) AS persistence, jump_class FROM jump""",
)
def jump_candidates(t):
    j = detectors.detect_jumps(retentions(t), "cycle", "retention")
    return j.select(
        "user_id",
        "jump_cycle",
        r6(F.col("jump_magnitude"), "jump_magnitude"),
        "jump_direction",
        r6(F.col("pre_slope"), "pre_slope"),
        "pre_n",
        "post_n",
        F.round("persistence", 5).alias("persistence"),
        "jump_class",
    )


@query("strict_jumps", "WITH " + jump_sql(0.05, 0.05) + "SELECT user_id, jump_cycle, jump_direction, jump_class FROM jump")
def strict_jumps(t):
    j = detectors.detect_jumps(retentions(t), "cycle", "retention", detectors.STRICT_JUMPS)
    return j.select("user_id", "jump_cycle", "jump_direction", "jump_class")


def lts_sql(side: str, sign: str) -> str:
    """Trimmed line through the five neighbours on one side: best of the ten 3-subsets."""
    return f"""
  {side}_pts AS (SELECT a.user_id, a.cycle, a.cycle {sign} n.d AS px, p.retention AS py, n.slot
     FROM ret a CROSS JOIN (VALUES (1, {1 if sign == "+" else 5}), (2, {2 if sign == "+" else 4}), (3, 3), (4, {4 if sign == "+" else 2}), (5, {5 if sign == "+" else 1})) n(d, slot)
     JOIN ret p ON p.user_id = a.user_id AND p.cycle = a.cycle {sign} n.d),
  {side}_full AS (SELECT user_id, cycle FROM {side}_pts GROUP BY 1, 2 HAVING count(*) = 5),
  {side}_fit AS (SELECT p.user_id, p.cycle, s.k, sum(p.px) AS sx, sum(p.py) AS sy, sum(CAST(p.px AS DOUBLE) * p.px) AS sxx, sum(p.px * p.py) AS sxy
     FROM {side}_pts p JOIN {side}_full f ON p.user_id = f.user_id AND p.cycle = f.cycle JOIN subs s ON p.slot = s.a OR p.slot = s.b OR p.slot = s.c
     GROUP BY 1, 2, 3),
  {side}_line AS (SELECT *, (3 * sxy - sx * sy) / (3 * sxx - sx * sx) AS m, (sy - (3 * sxy - sx * sy) / (3 * sxx - sx * sx) * sx) / 3 AS b FROM {side}_fit),
  {side}_ssr AS (SELECT l.user_id, l.cycle, l.k, any_value(l.m) AS m, any_value(l.b) AS b, sum((p.py - (l.m * p.px + l.b)) ** 2) AS ssr
     FROM {side}_line l JOIN subs s ON s.k = l.k JOIN {side}_pts p ON p.user_id = l.user_id AND p.cycle = l.cycle AND (p.slot = s.a OR p.slot = s.b OR p.slot = s.c)
     GROUP BY 1, 2, 3),
  {side}_best AS (SELECT user_id, cycle, arg_min(m * cycle + b, ssr + k * 1e-15) AS at FROM {side}_ssr GROUP BY 1, 2)"""


OUTLIER = (
    RET
    + """, subs(k, a, b, c) AS (VALUES (0,1,2,3),(1,1,2,4),(2,1,2,5),(3,1,3,4),(4,1,3,5),(5,1,4,5),(6,2,3,4),(7,2,3,5),(8,2,4,5),(9,3,4,5)),
"""
    + lts_sql("pre", "-")
    + ","
    + lts_sql("post", "+")
    + """,
  tested AS (SELECT r.user_id, r.cycle, r.retention, a.at AS pp, b.at AS pq, abs(a.at - b.at) AS gap,
      coalesce((a.at + b.at) * 0.5, a.at) AS predicted, r.retention - coalesce((a.at + b.at) * 0.5, a.at) AS residual
      FROM ret r JOIN pre_best a ON r.user_id = a.user_id AND r.cycle = a.cycle
      LEFT JOIN post_best b ON r.user_id = b.user_id AND r.cycle = b.cycle
      WHERE b.at IS NULL OR abs(a.at - b.at) <= 2.0),
  med AS (SELECT user_id, median(residual) AS med FROM tested GROUP BY 1),
  scale AS (SELECT t.user_id, any_value(m.med) AS med, median(abs(t.residual - m.med)) AS mad FROM tested t JOIN med m USING (user_id) GROUP BY 1)
"""
)

# The event values are noisy, so the step guard is widened; everything else is the default rule.
WIDE = detectors.OutlierRule(discontinuity_max=2.0)


def clean_retentions(t):
    return retentions(t).add(near=F.lit(False))


@query(
    "outlier_residuals",
    "WITH " + OUTLIER + "SELECT user_id, cycle, round(predicted, 4) AS predicted, round(residual, 4) AS residual, CASE WHEN pq IS NULL THEN 0 ELSE 3 END AS post_n FROM tested",
)
def outlier_residuals(t):
    rows = detectors.tested_residuals(clean_retentions(t), "cycle", "retention", rule=WIDE).rows()
    return rows.select(
        "user_id", "cycle", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"), "post_n"
    )


@query(
    "mad_scale",
    "WITH " + CYC + """, m AS (SELECT user_id, median(value) AS med FROM cyc GROUP BY 1)
    SELECT user_id, round(any_value(m.med), 6) AS med, round(median(abs(value - m.med)), 6) AS mad,
      round(greatest(1.4826 * median(abs(value - m.med)), 0.005), 6) AS sigma FROM cyc JOIN m USING (user_id) GROUP BY 1""",
)
def mad_scale(t):
    out = detectors.mad_scale(t.events.select("user_id", "value"), ["user_id"], "value", bound=t.rows("events"))
    return out.select("user_id", *[r6(F.col(c), c) for c in ("med", "mad", "sigma")])


@query(
    "outlier_flags",
    "WITH " + OUTLIER + """SELECT t.user_id, t.cycle AS outlier_cycle, round(t.retention, 6) AS retention, round(t.predicted, 4) AS predicted,
      round((t.residual - s.med) / greatest(1.4826 * s.mad, 0.005), 3) AS z_score FROM tested t JOIN scale s USING (user_id)
      WHERE abs(t.residual - s.med) > 4 * greatest(1.4826 * s.mad, 0.005)""",
)
def outlier_flags(t):
    out = detectors.detect_outliers(clean_retentions(t), "cycle", "retention", rule=WIDE)
    return out.select(
        "user_id",
        "outlier_cycle",
        r6(F.col("retention"), "retention"),
        F.round("predicted", 4).alias("predicted"),
        F.round("z_score", 3).alias("z_score"),
    )
