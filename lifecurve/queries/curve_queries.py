"""Queries on curves: integrals over event times, price-quantity curves, decay fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.operators import curves
from lifecurve.operators.ordered import arrange
from lifecurve.queries.common import CYC, cycles, r6
from lifecurve.queries.registry import query

# Samples: current = value, voltage = payload, time = seconds, one slice per user and event type.
SAMPLES = """sm AS (SELECT user_id, event_type AS phase, event_id, epoch(ts) AS t, value AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events),
sg AS (SELECT *, t - lag(t) OVER w AS dt, (i + lag(i) OVER w) / 2 * (t - lag(t) OVER w) AS q, (v * i + lag(v * i) OVER w) / 2 * (t - lag(t) OVER w) AS e
  FROM sm WINDOW w AS (PARTITION BY user_id, phase ORDER BY t, event_id))"""


def samples(t):
    return t.events.select(
        "user_id",
        F.col("event_type").alias("phase"),
        "event_id",
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6).alias("t"),
        F.dayofmonth("ts").alias("day"),
        F.col("value").alias("i"),
        F.get_json_object("props", "$.k").cast("double").alias("v"),
    )


@query("sample_steps", f"WITH {SAMPLES} SELECT user_id, phase, event_id, round(dt, 4) AS dt, round(q, 3) AS seg FROM sg")
def sample_steps(t):
    o = arrange(samples(t), ["user_id", "phase"], ["t", "event_id"], bound=t.rows("events"))
    rows = curves.with_segments(o, "t", seg=F.col("i")).rows()
    return rows.select("user_id", "phase", "event_id", F.round("dt", 4).alias("dt"), F.round("seg", 3).alias("seg"))


@query(
    "nominal_level",
    f"""WITH {SAMPLES} SELECT user_id, phase, count(*) AS n_samples, round(CASE WHEN count(*) >= 2 AND abs(sum(q)) >= 1e-12 THEN abs(sum(e)) / abs(sum(q)) END, 6) AS nominal FROM sg GROUP BY 1, 2""",
)
def nominal_level(t):
    out = curves.nominal_level(samples(t), ["user_id", "phase"], "t", "i", "v", ["t", "event_id"], bound=t.rows("events"))
    return out.withColumn("nominal", F.round("nominal", 6))


PHASES = """cp AS (SELECT user_id, abs(sum(coalesce(q, 0)) FILTER (WHERE phase = 'purchase')) / 3600 AS cap_chg_ah, abs(sum(coalesce(q, 0)) FILTER (WHERE phase = 'view')) / 3600 AS cap_dis_ah
  FROM sg WHERE phase IN ('purchase', 'view') GROUP BY 1)"""


@query(
    "phase_pivot",
    f"WITH {SAMPLES}, {PHASES} SELECT user_id, round(cap_chg_ah, 4) AS cap_chg_ah, round(cap_dis_ah, 4) AS cap_dis_ah, round(CASE WHEN cap_chg_ah > 0 THEN cap_dis_ah / cap_chg_ah END, 6) AS ce FROM cp",
)
def phase_pivot(t):
    out = curves.phase_capacity(
        samples(t), ["user_id"], "phase", "t", "i", ["t", "event_id"], charge="purchase", discharge="view", bound=t.rows("events")
    )
    return out.select("user_id", F.round("cap_chg_ah", 4).alias("cap_chg_ah"), F.round("cap_dis_ah", 4).alias("cap_dis_ah"), r6(F.col("ce"), "ce"))


@query(
    "cumulative_integral",
    f"""WITH {SAMPLES} SELECT user_id, phase, event_id, round(sum(coalesce(q, 0) / 3600) OVER (PARTITION BY user_id, phase ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 4) AS q FROM sg""",
)
def cumulative_integral(t):
    o = arrange(samples(t), ["user_id", "phase"], ["t", "event_id"], bound=t.rows("events"))
    return curves.cumulative_charge(o, "t", "i").rows().select("user_id", "phase", "event_id", F.round("q", 4).alias("q"))


@query(
    "half_cycle",
    f"""WITH {SAMPLES} SELECT user_id, CAST(floor(t) AS BIGINT) AS t, v, i, round(sum(coalesce(q, 0) / 3600) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 4) AS q FROM sg WHERE phase = 'view'""",
)
def half_cycle(t):
    out = curves.half_cycle(samples(t), ["user_id"], "phase", "view", "t", "i", "v", bound=t.rows("events"))
    return out.select("user_id", F.floor("t").alias("t"), "v", "i", F.round("q", 4).alias("q"))


@query(
    "first_minutes",
    f"WITH {SAMPLES}, f AS (SELECT user_id, phase, min(t) AS t0 FROM sm GROUP BY 1, 2) SELECT user_id, phase, event_id FROM sm JOIN f USING (user_id, phase) WHERE t - t0 <= 4320 * 60",
)
def first_minutes(t):
    return curves.first_minutes(samples(t), ["user_id", "phase"], "t", 4320).select("user_id", "phase", "event_id")


# Slices per user and week play the cycles.
@query(
    "tier_b_scalars",
    """WITH sm AS (SELECT user_id, least(day(ts) // 7, 4) AS wk, CASE WHEN event_type IN ('view', 'click') THEN 'charge' ELSE 'discharge' END AS phase, event_id, epoch(ts) AS t, value AS i,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events),
    sg AS (SELECT *, (i + lag(i) OVER w) / 2 * (t - lag(t) OVER w) AS q, (v * i + lag(v * i) OVER w) / 2 * (t - lag(t) OVER w) AS e FROM sm WINDOW w AS (PARTITION BY user_id, wk, phase ORDER BY t, event_id)),
    nl AS (SELECT user_id, wk, phase, CASE WHEN count(*) >= 2 AND abs(sum(q)) >= 1e-12 THEN abs(sum(e)) / abs(sum(q)) END AS nom FROM sg GROUP BY 1, 2, 3),
    w AS (SELECT user_id, wk, max(nom) FILTER (WHERE phase = 'charge') AS c, max(nom) FILTER (WHERE phase = 'discharge') AS d FROM nl GROUP BY 1, 2),
    a AS (SELECT user_id, count(*) AS n, bool_and(c IS NOT NULL AND d IS NOT NULL) AS full_, arg_min(c, wk) AS c0, arg_min(d, wk) AS d0, max(d) AS dm, stddev_samp(d) AS ds, max(c) AS cm FROM w GROUP BY 1)
    SELECT user_id, round(CASE WHEN n >= 2 AND full_ AND c0 > 0 AND d0 > 0 THEN dm / d0 END, 6) AS discharge_nominal_voltage_retention_max,
     round(CASE WHEN n >= 2 AND full_ AND c0 > 0 AND d0 > 0 THEN ds / d0 END, 6) AS discharge_nominal_voltage_retention_std,
     round(CASE WHEN n >= 2 AND full_ AND c0 > 0 AND d0 > 0 THEN cm / c0 END, 6) AS charge_nominal_voltage_retention_max FROM a""",
)
def tier_b_scalars(t):
    phase = F.when(F.col("phase").isin("view", "click"), "charge").otherwise("discharge")
    week = F.least(F.floor(F.col("day") / 7), F.lit(4)).alias("wk")
    rows = samples(t).select("user_id", week, phase.alias("phase"), "event_id", "t", "i", "v")
    nominal = curves.nominal_level(rows, ["user_id", "wk", "phase"], "t", "i", "v", ["t", "event_id"], bound=t.rows("events"))
    window = rows.select("user_id", "wk").distinct()
    out = curves.tier_b(nominal, window, "user_id", "wk", "phase")
    return out.select("user_id", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(
    "skip_missing_rollup",
    "WITH " + CYC + """, v AS (SELECT user_id, cycle, CASE WHEN k < 10 THEN NULL ELSE value END AS v FROM cyc)
    SELECT user_id, round(avg(v) FILTER (WHERE cycle IN (3, 4, 5)), 6) AS mean, round(stddev_pop(v) FILTER (WHERE cycle IN (3, 4, 5)), 6) AS std,
      round(max(v) FILTER (WHERE cycle = 5) - max(v) FILTER (WHERE cycle = 3), 6) AS delta FROM v GROUP BY 1""",
)
def skip_missing_rollup(t):
    rows = cycles(t, "k").rows().withColumn("v", F.when(F.col("k") < 10, F.lit(float("nan"))).otherwise(F.col("value")))
    out = curves.skip_missing_rollup(rows, "user_id", "cycle", "v", [3, 4, 5])
    return out.select("user_id", *[r6(F.col(c), c) for c in ("mean", "std", "delta")])


@query(
    "ratio_features",
    "WITH " + CYC + """, f AS (SELECT user_id, max(k) FILTER (WHERE cycle = 3)::DOUBLE AS a, max(k) FILTER (WHERE cycle = 4)::DOUBLE AS b, max(k) FILTER (WHERE cycle = 5)::DOUBLE AS c FROM cyc GROUP BY 1),
    r AS (SELECT *, CASE WHEN a >= 0.5 THEN (100 - a) / a END AS ra, CASE WHEN b >= 0.5 THEN (100 - b) / b END AS rb, CASE WHEN c >= 0.5 THEN (100 - c) / c END AS rc FROM f)
    SELECT user_id, round(list_avg([x FOR x IN [ra, rb, rc] IF x IS NOT NULL]), 6) AS "A_slow_to_fast_mean", round(rc - ra, 6) AS "A_slow_to_fast_delta",
      round(CASE WHEN rc <> 0 THEN ln(abs(rc)) END - CASE WHEN ra <> 0 THEN ln(abs(ra)) END, 6) AS "log_A_slow_to_fast_delta",
      round(CASE WHEN abs(list_avg([a, b, c])) >= 0.5 THEN list_stddev_pop([a, b, c]) / abs(list_avg([a, b, c])) END, 6) AS "A_fast_frac_cv" FROM r""",
)
def ratio_features(t):
    c = cycles(t, "k").rows()
    wide = c.groupBy("user_id").agg(
        *[F.max(F.when(F.col("cycle") == n, F.col("k"))).cast("double").alias(f"f{n}") for n in (3, 4, 5)]
    )
    made = curves.engineered_ratios([F.col("f3"), F.col("f4"), F.col("f5")])
    return wide.select("user_id", *[r6(v, n) for n, v in made.items()])


# Price-quantity curves per return flag: one curve per line status, one point per price band.
CURVES = """pt AS (SELECT l_returnflag AS flag, l_linestatus AS st, floor(l_extendedprice / 2500) AS band, round(avg(l_extendedprice), 6) AS x, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2, 3),
rg AS (SELECT flag, max(lo) AS lo, min(hi) AS hi FROM (SELECT flag, st, min(x) AS lo, max(x) AS hi FROM pt GROUP BY 1, 2) GROUP BY 1),
gr AS (SELECT flag, i, lo + i * 1000.0::DOUBLE AS x FROM rg, LATERAL (SELECT unnest(range(0, CAST(ceil((hi + 500 - lo) / 1000) AS BIGINT))) AS i) u),
ip AS (SELECT g.flag, s.st, g.i, g.x, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM gr g CROSS JOIN (SELECT DISTINCT st FROM pt) s
   ASOF LEFT JOIN pt a ON a.flag = g.flag AND a.st = s.st AND a.x <= g.x ASOF LEFT JOIN pt b ON b.flag = g.flag AND b.st = s.st AND b.x >= g.x),
cv AS (SELECT flag, st, i, x, CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = x THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END AS y FROM ip)"""


def price_curves(t):
    pts = t.lineitem.groupBy(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"), F.floor(F.col("l_extendedprice") / 2500).alias("band")
    ).agg(F.round(F.avg("l_extendedprice"), 6).alias("x"), F.round(F.avg("l_quantity"), 6).alias("y"))
    return pts.where("st = 'F'").drop("st", "band"), pts.where("st = 'O'").drop("st", "band")


@query(
    "grid_interpolation",
    f"WITH {CURVES} SELECT flag, i, round(x, 4) AS x, round(max(y) FILTER (WHERE st = 'F'), 4) AS a, round(max(y) FILTER (WHERE st = 'O'), 4) AS b FROM cv GROUP BY flag, i, x",
)
def grid_interpolation(t):
    a, b = price_curves(t)
    out = curves.two_curves_on_grid(a, b, ["flag"], "x", "y", 1000.0, bound=t.rows("lineitem"))
    return out.select("flag", "i", *[F.round(c, 4).alias(c) for c in ("x", "a", "b")])


@query(
    "curve_cosine",
    f"""WITH {CURVES}, w AS (SELECT flag, i, max(y) FILTER (WHERE st = 'F') AS a, max(y) FILTER (WHERE st = 'O') AS b FROM cv GROUP BY 1, 2)
    SELECT flag, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine FROM w GROUP BY 1""",
)
def curve_cosine(t):
    a, b = price_curves(t)
    out = curves.cosine_similarity(a, b, ["flag"], "x", "y", 1000.0, bound=t.rows("lineitem"))
    return out.withColumn("cosine", F.round("cosine", 6))


@query(
    "delta_q_stats",
    f"""WITH {CURVES}, cap AS (SELECT flag, max(y) - min(y) AS c FROM pt WHERE st = 'F' GROUP BY 1),
    d AS (SELECT flag, i, (abs(max(y) FILTER (WHERE st = 'O')) - abs(max(y) FILTER (WHERE st = 'F'))) / any_value(c) AS d FROM cv JOIN cap USING (flag) GROUP BY 1, 2),
    m AS (SELECT flag, avg(d) AS m, var_pop(d) AS v, min(d) AS lo FROM d GROUP BY 1)
    SELECT flag, round(any_value(log10(v)), 6) AS dqv_norm_c5_c1_var_log10, round(any_value(lo), 6) AS dqv_norm_c5_c1_min, round(any_value(m), 6) AS dqv_norm_c5_c1_mean,
      round(avg(((d - m) / sqrt(v)) ** 3), 5) AS dqv_norm_c5_c1_skew FROM d JOIN m USING (flag) GROUP BY 1""",
)
def delta_q_stats(t):
    a, b = price_curves(t)
    cap = a.groupBy("flag").agg((F.max("y") - F.min("y")).alias("capacity"))
    out = curves.delta_q_stats(a, b, ["flag"], "x", "y", cap, 1000.0, bound=t.rows("lineitem"))
    p = "dqv_norm_c5_c1"
    return out.select("flag", *[r6(F.col(f"{p}_{s}"), f"{p}_{s}") for s in ("var_log10", "min", "mean")], F.round(f"{p}_skew", 5).alias(f"{p}_skew"))


def demand_curve(t):
    """Lines per price band and brand: a bumpy curve on an even grid."""
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_brand", (F.floor(F.col("l_extendedprice") / 2000) * 2000.0).alias("x")
    ).agg(F.count(F.lit(1)).cast("double").alias("y"))


@query(
    "dominant_peak",
    """WITH c AS (SELECT p_brand, floor(l_extendedprice / 2000) * 2000 AS x, count(*)::DOUBLE AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER w AS pos, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
    r AS (SELECT *, sum(CASE WHEN py IS NULL OR py <> y THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY pos) AS run FROM n),
    g AS (SELECT p_brand, run, min(pos) AS f, max(pos) AS t, max(y) AS s FROM r GROUP BY 1, 2),
    k AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b, max(s) OVER (PARTITION BY p_brand) AS top FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY run)),
    p AS (SELECT k.*, coalesce((SELECT max(q.run) FROM g q WHERE q.p_brand = k.p_brand AND q.run < k.run AND q.s > k.s), 0) AS lb,
       coalesce((SELECT min(q.run) FROM g q WHERE q.p_brand = k.p_brand AND q.run > k.run AND q.s > k.s), 1000000) AS rb FROM k WHERE s > a AND s > b),
    m AS (SELECT p.*, s - greatest((SELECT min(q.s) FROM g q WHERE q.p_brand = p.p_brand AND q.run > p.lb AND q.run <= p.run),
       (SELECT min(q.s) FROM g q WHERE q.p_brand = p.p_brand AND q.run >= p.run AND q.run < p.rb)) AS prom FROM p),
    z AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n_peaks, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, run) AS rn FROM m WHERE prom >= 0.05 * top)
    SELECT z.p_brand, n.x AS peak_x, n.y AS peak_y, z.n_peaks FROM z JOIN n ON n.p_brand = z.p_brand AND n.pos = (z.f + z.t) // 2 WHERE rn = 1""",
)
def dominant_peak(t):
    return curves.dominant_peak(demand_curve(t), ["p_brand"], "x", "y", distance=1, bound=t.rows("lineitem"))


# Higher peaks first, each kept if none kept before lies nearer than five samples.
@query(
    "spaced_peak",
    """WITH RECURSIVE c AS (SELECT p_brand, floor(l_extendedprice / 2000) * 2000 AS x, count(*)::DOUBLE AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER w AS pos, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY x)),
    r AS (SELECT *, sum(CASE WHEN py IS NULL OR py <> y THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY pos) AS run FROM n),
    g AS (SELECT p_brand, run, (min(pos) + max(pos)) // 2 AS mid, max(y) AS s FROM r GROUP BY 1, 2),
    k AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b, max(s) OVER (PARTITION BY p_brand) AS top FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY run)),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, run DESC) AS rk FROM k WHERE s > a AND s > b),
    kp AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept FROM o
      UNION ALL SELECT kp.p_brand, o.rk, CASE WHEN len([m FOR m IN kept IF abs(m - o.mid) < 5]) = 0 THEN list_append(kept, o.mid) ELSE kept END
      FROM kp JOIN o ON o.p_brand = kp.p_brand AND o.rk = kp.step + 1),
    e AS (SELECT p_brand, arg_max(kept, step) AS kept FROM kp GROUP BY 1),
    p AS (SELECT o.*, coalesce((SELECT max(q.run) FROM g q WHERE q.p_brand = o.p_brand AND q.run < o.run AND q.s > o.s), 0) AS lb,
       coalesce((SELECT min(q.run) FROM g q WHERE q.p_brand = o.p_brand AND q.run > o.run AND q.s > o.s), 1000000) AS rb FROM o JOIN e ON e.p_brand = o.p_brand AND list_contains(e.kept, o.mid)),
    m AS (SELECT p.*, s - greatest((SELECT min(q.s) FROM g q WHERE q.p_brand = p.p_brand AND q.run > p.lb AND q.run <= p.run),
       (SELECT min(q.s) FROM g q WHERE q.p_brand = p.p_brand AND q.run >= p.run AND q.run < p.rb)) AS prom FROM p),
    z AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n_peaks, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, run) AS rn FROM m WHERE prom >= 0.05 * top)
    SELECT z.p_brand, n.x AS peak_x, n.y AS peak_y, z.n_peaks FROM z JOIN n ON n.p_brand = z.p_brand AND n.pos = z.mid WHERE rn = 1""",
)
def spaced_peak(t):
    return curves.dominant_peak(demand_curve(t), ["p_brand"], "x", "y", distance=5, bound=t.rows("lineitem"))


# The slope of a cubic through 51 even points in closed form: only odd powers of the place count.
@query(
    "smoothed_derivative",
    """WITH pt AS (SELECT l_returnflag AS flag, l_linestatus AS st, floor(l_extendedprice / 2500) AS band, round(avg(l_extendedprice), 6) AS x, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2, 3),
    rg AS (SELECT flag, st, min(x) AS lo, max(x) AS hi FROM pt GROUP BY 1, 2 HAVING max(x) - min(x) >= 500),
    gr AS (SELECT flag, st, i, lo + i * 500.0::DOUBLE AS x FROM rg, LATERAL (SELECT unnest(range(0, CAST(ceil((hi + 250 - lo) / 500) AS BIGINT))) AS i) u),
    ip AS (SELECT g.*, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM gr g ASOF LEFT JOIN pt a ON a.flag = g.flag AND a.st = g.st AND a.x <= g.x ASOF LEFT JOIN pt b ON b.flag = g.flag AND b.st = g.st AND b.x >= g.x),
    cv AS (SELECT flag, st, i, x, CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = x THEN ya ELSE ya + (yb - ya) * (x - xa) / (xb - xa) END AS y FROM ip),
    w AS (SELECT *, list(y) OVER (PARTITION BY flag, st ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS ys FROM cv),
    s AS (SELECT sum(j ** 2)::DOUBLE AS s2, sum(j ** 4)::DOUBLE AS s4, sum(j ** 6)::DOUBLE AS s6 FROM range(-25, 26) t(j)),
    m AS (SELECT *, list_sum([(j - 25) * ys[j + 1] FOR j IN range(0, 51)]) AS m1, list_sum([(j - 25) * (j - 25) * (j - 25) * ys[j + 1] FOR j IN range(0, 51)]) AS m3 FROM w WHERE len(ys) = 51)
    SELECT flag, CASE st WHEN 'F' THEN 'a' ELSE 'b' END AS curve, i, round(x, 4) AS x, round((s6 * m1 - s4 * m3) / (s2 * s6 - s4 * s4) / 500, 8) AS slope FROM m, s""",
)
def smoothed_derivative(t):
    both = [c.withColumn("curve", F.lit(name)) for c, name in zip(price_curves(t), ("a", "b"))]
    out = curves.smoothed_derivative(both[0].unionByName(both[1]), ["flag", "curve"], "x", "y", 500.0, bound=t.rows("lineitem"))
    return out.select("flag", "curve", "i", F.round("x", 4).alias("x"), F.round("slope", 8).alias("slope"))


PEAKS = """pk AS (SELECT user_id, least(day(ts) // 7, 4) + 1 AS wk, CASE WHEN event_type IN ('view', 'click') THEN 'charge' ELSE 'discharge' END AS dir,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS theta, value AS rho, event_id FROM events)"""


def peak_rows(t):
    return samples(t).select(
        "user_id",
        (F.least(F.floor(F.col("day") / 7), F.lit(4)) + 1).alias("wk"),
        F.when(F.col("phase").isin("view", "click"), "charge").otherwise("discharge").alias("dir"),
        F.col("v").alias("theta"),
        F.col("i").alias("rho"),
        "event_id",
    )


def theta_sql():
    cells = [(c, d, s) for d, s in (("charge", "chg"), ("discharge", "dis")) for c in (1, 5)]
    picks = ", ".join(
        f"max(theta) FILTER (WHERE wk = {c} AND dir = '{d}' AND rn = 1) AS dop_peak_theta_c{c}_{s}" for c, d, s in cells
    )
    shifts = ", ".join(f"dop_peak_theta_c5_{s} - dop_peak_theta_c1_{s} AS dop_peak_theta_shift_{s}_c1c5" for s in ("chg", "dis"))
    names = [f"dop_peak_theta_c{c}_{s}" for c, _, s in cells] + [f"dop_peak_theta_shift_{s}_c1c5" for s in ("chg", "dis")]
    total = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names)
    return f"""WITH {PEAKS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, wk, dir ORDER BY rho DESC, event_id) AS rn FROM pk),
    w AS (SELECT user_id, {picks} FROM o GROUP BY 1), s AS (SELECT *, {shifts} FROM w) SELECT *, {total} AS n_features_success FROM s"""


@query("theta_features", theta_sql())
def theta_features(t):
    return curves.theta_features(peak_rows(t), "user_id", "wk", "dir", "theta", "rho", "event_id")


@query(
    "peak_features",
    f"""WITH {PEAKS}, o AS (SELECT user_id, wk, dir, arg_max(theta, rho) AS px FROM pk GROUP BY 1, 2, 3),
    w AS (SELECT user_id, max(px) FILTER (WHERE wk = 5 AND dir = 'discharge') AS l, max(px) FILTER (WHERE wk = 1 AND dir = 'discharge') AS f, max(px) FILTER (WHERE wk = 5 AND dir = 'charge') AS c FROM o GROUP BY 1)
    SELECT user_id, l AS dqdv_peak_v_c5_dis, l - f AS dqdv_peak_v_shift_c1c5_dis, c - l AS dqdv_charge_discharge_hysteresis_c5 FROM w""",
)
def peak_features(t):
    return curves.peak_features(best_peaks(t), "user_id", "wk", "dir")


def best_peaks(t):
    return peak_rows(t).groupBy("user_id", "wk", "dir").agg(F.max_by("theta", "rho").alias("peak_x"))


@query(
    "curve_status",
    f"""WITH {PEAKS}, o AS (SELECT user_id, wk, dir, arg_max(theta, rho) AS px FROM pk GROUP BY 1, 2, 3),
    w AS (SELECT user_id, max(px) FILTER (WHERE wk = 5 AND dir = 'discharge') AS l, max(px) FILTER (WHERE wk = 1 AND dir = 'discharge') AS f, max(px) FILTER (WHERE wk = 5 AND dir = 'charge') AS c FROM o GROUP BY 1),
    h AS (SELECT user_id, bool_or(wk = 1 AND dir = 'discharge') AS has_c1_dis, bool_or(wk = 5 AND dir = 'discharge') AS has_c5_dis, bool_or(wk = 5 AND dir = 'charge') AS has_c5_chg FROM pk GROUP BY 1)
    SELECT h.*, CAST(l IS NOT NULL AS INT) + CAST(l - f IS NOT NULL AS INT) + CAST(c - l IS NOT NULL AS INT) AS n_success FROM h JOIN w USING (user_id)""",
)
def curve_status(t):
    feats = curves.peak_features(best_peaks(t), "user_id", "wk", "dir")
    wanted = [(1, "discharge", "c1_dis"), (5, "discharge", "c5_dis"), (5, "charge", "c5_chg")]
    return curves.curve_status(peak_rows(t), "user_id", "wk", "dir", feats, wanted)


def decay_samples(t):
    """Waiting time in minutes until each later event of a user within its type: a decaying histogram by the hour."""
    s = samples(t)
    o = arrange(s, ["user_id", "phase"], ["t", "event_id"], bound=t.rows("events"))
    gaps = o.frames(1, 0, gap=lambda w: F.col("t") - F.lag("t").over(w)).rows().where("gap is not null")
    return gaps.groupBy("phase", (F.floor(F.col("gap") / 3600) * 60.0).alias("wait")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )


def decay_rows(t):
    return curves.decay_fit(decay_samples(t), ["phase"], "wait", "n")


def decay_sql(coarse: tuple[int, int, int] = (12, 12, 8), refine: int = 4) -> str:
    """The grid fit in SQL: all candidates against all samples, amplitudes from the normal equations, level by level."""
    listed = lambda values: ", ".join(f"('{v!r}'::DOUBLE)" for v in values)
    limits = (curves.TAU_FAST, curves.TAU_SLOW, curves.BETA)
    grids = [listed(curves.spread(li, n)) for li, n in zip(limits, coarse, strict=True)]
    ratios = [(li[1] / li[0]) ** (1 / (n - 1)) for li, n in zip(limits, coarse, strict=True)]
    parts = [
        """g AS (SELECT event_type AS phase, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts), event_id) AS gap FROM events),
    p AS (SELECT phase, floor(gap / 3600) * 60.0::DOUBLE AS t, count(*)::DOUBLE AS y FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)""",
        f"c0 AS (SELECT phase, tf, ts, beta FROM (SELECT DISTINCT phase FROM p), (VALUES {grids[0]}) a(tf), (VALUES {grids[1]}) b(ts), (VALUES {grids[2]}) c(beta))",
    ]
    for level in range(refine + 1):
        if level:
            around = [listed([f**-2, 1 / f, 1.0, f, f**2]) for f in (r ** (0.5**level) for r in ratios)]
            held = lambda c, m, li: f"greatest(least({c} * {m}, {li[1]!r}::DOUBLE), {li[0]!r}::DOUBLE)"
            cells = ", ".join(f"{held(c, m, li)} AS {c}" for c, m, li in zip(("tf", "ts", "beta"), ("m1", "m2", "m3"), limits, strict=True))
            parts.append(f"c{level} AS (SELECT DISTINCT phase, {cells} FROM b{level - 1}, (VALUES {around[0]}) a(m1), (VALUES {around[1]}) b(m2), (VALUES {around[2]}) c(m3))")
        parts.append(f"""s{level} AS (SELECT phase, tf, ts, beta, count(*) AS n, sum(y) AS y1, sum(y * y) AS yy, sum(f * f) AS ff, sum(s * s) AS ss, sum(f * s) AS fs, sum(f * y) AS fy, sum(s * y) AS sy
      FROM (SELECT c.*, p.y, exp(-p.t / c.tf) AS f, exp(-power(p.t / c.ts, c.beta)) AS s FROM c{level} c JOIN p USING (phase)) GROUP BY 1, 2, 3, 4),
    a{level} AS (SELECT *, (fy * ss - sy * fs) / nullif(ff * ss - fs * fs, 0) AS af, (sy * ff - fy * fs) / nullif(ff * ss - fs * fs, 0) AS sa FROM s{level}),
    b{level} AS (SELECT *, yy - af * fy - sa * sy AS sse FROM a{level} WHERE af >= 0 AND sa >= 0 AND tf < ts QUALIFY row_number() OVER (PARTITION BY phase ORDER BY yy - af * fy - sa * sy, tf, ts, beta) = 1)""")
    inside = " AND ".join(f"{c} > {li[0] + curves.BOUND_GAP!r} AND {c} < {li[1] - curves.BOUND_GAP!r}" for c, li in zip(("tf", "ts", "beta"), limits, strict=True))
    return "WITH " + ",\n    ".join(parts) + f""",
    r AS (SELECT q.phase, q.n_samples, tf, ts, beta, af / nullif(af + sa, 0) * 100 AS frac, 1 - sse / nullif(yy - y1 * y1 / n, 0) AS r2 FROM (SELECT phase, count(*) AS n_samples FROM p GROUP BY 1) q LEFT JOIN b{refine} b USING (phase)),
    k AS (SELECT *, coalesce({inside} AND frac > 0 AND frac < 100, false) AS ok FROM r)
    SELECT phase, n_samples, round(tf, 4) AS tau_fast, round(ts, 4) AS tau_slow, round(frac, 4) AS "A_fast_frac", round(beta, 4) AS beta, round(r2, 4) AS r_squared, ok AS success,
      CASE WHEN tf IS NULL THEN 'non-converged' WHEN NOT ok THEN 'pinned-to-bound' ELSE '' END AS error_msg FROM k"""


@query("decay_grid_fit", decay_sql())
def decay_grid_fit(t):
    out = decay_rows(t)
    return out.select(
        "phase", "n_samples", *[F.round(c, 4).alias(c) for c in ("tau_fast", "tau_slow", "A_fast_frac", "beta", "r_squared")], "success", "error_msg"
    )


# Parameter rows as a solver would leave them: payload and value give the parameters.
FITS = """ft AS (SELECT user_id, cycle, k * 10.0::DOUBLE AS tf, value * 50 AS ts, (k % 20) / 4.0::DOUBLE AS beta, k::DOUBLE AS frac FROM cyc WHERE cycle IN (3, 4, 5)),
fs AS (SELECT *, tf > 10.001 AND tf < 4999.999 AND ts > 100.001 AND ts < 49999.999 AND beta > 0.301 AND beta < 4.999 AND frac > 0 AND frac < 100 AS success FROM ft)"""


def fit_rows(t):
    c = cycles(t, "k").rows().where(F.col("cycle").isin(3, 4, 5))
    df = c.select(
        "user_id",
        "cycle",
        (F.col("k") * 10.0).alias("tau_fast"),
        (F.col("value") * 50).alias("tau_slow"),
        ((F.col("k") % 20) / 4.0).alias("beta"),
        F.col("k").cast("double").alias("A_fast_frac"),
    )
    ok = curves.within_bounds(F.col("tau_fast"), F.col("tau_slow"), F.col("beta"), F.col("A_fast_frac"))
    return df.withColumn("success", ok)


@query("fit_acceptance", "WITH " + CYC + "," + FITS + "SELECT user_id, cycle, success FROM fs")
def fit_acceptance(t):
    return fit_rows(t).select("user_id", "cycle", "success")


@query("success_distribution", "WITH " + CYC + "," + FITS + ", c AS (SELECT user_id, count(*) FILTER (WHERE success) AS n_success FROM fs GROUP BY 1) SELECT n_success, count(*) AS n_entities FROM c GROUP BY 1")
def success_distribution(t):
    return curves.success_distribution(fit_rows(t), "user_id")


@query(
    "tier_c_scalars",
    "WITH " + CYC + "," + FITS + """, g AS (SELECT user_id, max(frac) FILTER (WHERE cycle = 3 AND success) AS f3, max(frac) FILTER (WHERE cycle = 4 AND success) AS f4, max(frac) FILTER (WHERE cycle = 5 AND success) AS f5,
     max(ts / tf) FILTER (WHERE cycle = 3 AND success) AS r3, max(ts / tf) FILTER (WHERE cycle = 5 AND success) AS r5, avg(ts / tf) FILTER (WHERE success) AS rm, stddev_pop(ts / tf) FILTER (WHERE success) AS rs FROM fs GROUP BY 1)
    SELECT user_id, f3 AS "cv_A_fast_frac_c3", f4 AS "cv_A_fast_frac_c4", f5 AS "cv_A_fast_frac_c5", round(rm, 6) AS cv_tau_ratio_mean, round(rs, 6) AS cv_tau_ratio_std, round(r5 - r3, 6) AS cv_tau_ratio_delta,
     round((100 - f5) / f5 - (100 - f3) / f3, 6) AS "A_slow_to_fast_delta" FROM g""",
)
def tier_c_scalars(t):
    out = curves.tier_c(fit_rows(t), "user_id", "cycle")
    keep = ["cv_tau_ratio_mean", "cv_tau_ratio_std", "cv_tau_ratio_delta", "A_slow_to_fast_delta"]
    return out.select("user_id", *[f"cv_A_fast_frac_c{c}" for c in (3, 4, 5)], *[r6(F.col(c), c) for c in keep])
