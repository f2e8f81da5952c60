"""Queries on prediction tables: classification, regression and survival metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.functions.scalars import risk_positive
from lifecurve.operators import metrics, ranks, survival
from lifecurve.queries.common import HORIZONS, cycles, r6
from lifecurve.queries.label_stack import STATUS, fade_status
from lifecurve.queries.registry import query

# Document quality predicted by length; the language is the cohort.
DOCS = "docs AS (SELECT d.doc_id, l.quality AS y, CAST(d.n_chars >= 1500 AS INT) AS yhat, CAST(d.n_chars AS DOUBLE) AS score, d.lang FROM labels l JOIN documents d USING (doc_id))"


def doc_scores(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        (F.col("n_chars") >= 1500).cast("int").alias("yhat"),
        F.col("n_chars").cast("double").alias("score"),
        "lang",
    )


SCOPED = "sc AS (SELECT 'all' AS scope, * FROM docs UNION ALL SELECT lang, * FROM docs)"
AUC_SQL = """au AS (SELECT scope, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs, sum(y) AS p, count(*) - sum(y) AS q FROM
  (SELECT scope, y, (rank() OVER (PARTITION BY scope ORDER BY score) + (count(*) OVER (PARTITION BY scope, score) - 1) / 2.0) AS rk FROM sc) GROUP BY 1)"""


@query(
    "clf_metrics",
    f"""WITH {DOCS}, {SCOPED}, {AUC_SQL},
    cm AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
      count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM sc GROUP BY 1)
    SELECT cm.scope, n, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
      round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_negative,
      round(CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END, 6) AS roc_auc FROM cm JOIN au USING (scope)""",
)
def clf_metrics(t):
    out = metrics.classification_metrics(doc_scores(t), [], "y", "yhat", "score", "lang", bound=t.rows("labels"))
    rounded = ["accuracy", "precision", "recall", "f1", "f1_negative", "roc_auc"]
    return out.select("scope", "n", *[r6(F.col(c), c) for c in rounded])


@query(
    "roc_auc",
    f"WITH {DOCS}, sc AS (SELECT 'all' AS scope, * FROM docs), {AUC_SQL} SELECT round((rs - p * (p + 1) / 2) / (p * q), 6) AS auc FROM au",
)
def roc_auc(t):
    return ranks.roc_auc(doc_scores(t), [], "y", "score", bound=t.rows("labels")).select(r6(F.col("auc"), "auc"))


# Two users' event values compared: was it an error event, ranked by value, per user.
@query(
    "auc_by_user",
    """WITH sc AS (SELECT user_id AS scope, CAST(event_type = 'error' AS INT) AS y, value AS score FROM events), """
    + AUC_SQL
    + " SELECT scope AS user_id, round(CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END, 6) AS auc FROM au",
)
def auc_by_user(t):
    df = t.events.select("user_id", "value", (F.col("event_type") == "error").cast("int").alias("y"))
    return ranks.roc_auc(df, ["user_id"], "y", "value", bound=t.rows("events")).select("user_id", r6(F.col("auc"), "auc"))


@query(
    "roc_points",
    """WITH x AS (SELECT l_returnflag AS flag, CAST(l_linestatus = 'F' AS INT) AS y, l_quantity AS s FROM lineitem),
    c AS (SELECT flag, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM x GROUP BY 1, 2),
    r AS (SELECT flag, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY flag) AS p, sum(neg) OVER (PARTITION BY flag) AS q FROM c
      WINDOW w AS (PARTITION BY flag ORDER BY s DESC))
    SELECT flag, s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(q - fp AS BIGINT) AS tn,
     round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr FROM r""",
)
def roc_points(t):
    df = t.lineitem.select(
        F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").cast("int").alias("y"), "l_quantity"
    )
    out = ranks.roc_points(df, ["flag"], "y", "l_quantity", bound=t.rows("lineitem"))
    return out.select("flag", "threshold", "tp", "fp", "fn", "tn", r6(F.col("tpr"), "tpr"), r6(F.col("fpr"), "fpr"))


# Line price predicted from quantity and list price.
PRICE = "pr AS (SELECT l_returnflag AS flag, l_extendedprice AS y, l_quantity * p_retailprice AS yhat FROM lineitem JOIN part ON l_partkey = p_partkey)"


def price_predictions(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"),
    )


@query(
    "regression_metrics",
    f"""WITH {PRICE}, sc AS (SELECT 'all' AS scope, * FROM pr UNION ALL SELECT flag, * FROM pr)
    SELECT scope, count(*) AS n, round(avg(abs(yhat - y)), 4) AS mae, round(sqrt(avg((yhat - y) ** 2)), 4) AS rmse,
      round(1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(median(abs(yhat - y)), 4) AS medae FROM sc GROUP BY 1""",
)
def regression_metrics(t):
    out = metrics.regression_metrics(price_predictions(t), [], "y", "yhat", "flag", bound=t.rows("lineitem"))
    return out.select(
        "scope", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse")], r6(F.col("r2"), "r2"), F.round("medae", 4).alias("medae")
    )


@query("mape", f"WITH {PRICE} SELECT flag, round(avg(abs(yhat - y) / y) FILTER (WHERE y > 0), 6) AS mape FROM pr GROUP BY 1")
def mape(t):
    return metrics.mape(price_predictions(t), ["flag"], "y", "yhat").select("flag", r6(F.col("mape"), "mape"))


@query(
    "quartile_mae",
    f"""WITH {PRICE}, q AS (SELECT flag, quantile_cont(y, 0.25) q1, quantile_cont(y, 0.5) q2, quantile_cont(y, 0.75) q3 FROM pr GROUP BY 1)
    SELECT flag, round(avg(abs(yhat - y)) FILTER (WHERE y <= q1), 4) AS mae_q1, round(avg(abs(yhat - y)) FILTER (WHERE y > q1 AND y <= q2), 4) AS mae_q2,
     round(avg(abs(yhat - y)) FILTER (WHERE y > q2 AND y <= q3), 4) AS mae_q3, round(avg(abs(yhat - y)) FILTER (WHERE y > q3), 4) AS mae_q4
    FROM pr JOIN q USING (flag) GROUP BY 1""",
)
def quartile_mae(t):
    out = metrics.quartile_mae(price_predictions(t), ["flag"], "y", "yhat", bound=t.rows("lineitem"))
    return out.select("flag", *[F.round(f"mae_q{i}", 4).alias(f"mae_q{i}") for i in (1, 2, 3, 4)])


# Survival predictions: time and event from the fade rule, one risk per user and event type
# (the event type plays the seed), cohort by the mean payload.
SURV = (
    STATUS
    + """,
per_user AS (SELECT user_id, CASE WHEN avg(k) >= 50 THEN 'high' ELSE 'low' END AS cohort FROM cyc GROUP BY 1),
risks AS (SELECT user_id, event_type AS seed, -round(avg(value), 9) AS risk FROM cyc GROUP BY 1, 2),
sv AS (SELECT r.user_id, r.seed, r.risk, p.cohort, s.status = 'faded' AS event,
   CASE WHEN s.status = 'faded' THEN s.last_fade_cycle ELSE s.n_regular END AS time
   FROM risks r JOIN per_user p USING (user_id) JOIN st s USING (user_id))
"""
)


def survival_rows(t):
    c = cycles(t, "event_type", "k").rows()
    per_user = c.groupBy("user_id").agg(
        F.when(F.avg("k") >= 50, "high").otherwise("low").alias("cohort")
    )
    risk = c.groupBy("user_id", F.col("event_type").alias("seed")).agg(
        risk_positive(F.round(F.avg("value"), 9), "time_high").alias("risk")
    )
    event = F.col("status") == "faded"
    truth = fade_status(t).select(
        "user_id", event.alias("event"), F.when(event, F.col("last_fade_cycle")).otherwise(F.col("n_regular")).alias("time")
    )
    return risk.join(per_user, "user_id").join(truth, "user_id")


PAIRS = """pairs AS (SELECT a.{g} AS g, count(*) AS n_pairs, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS won
   FROM {src} a JOIN {src} b ON a.{g} = b.{g} AND a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event)) GROUP BY 1)"""


@query(
    "c_index",
    "WITH " + SURV + "," + PAIRS.format(g="seed", src="sv") + """,
    tot AS (SELECT seed, count(*) AS n, count(*) FILTER (WHERE event) AS n_events FROM sv GROUP BY 1)
    SELECT seed, n, n_events, n_pairs, round(CASE WHEN n_events >= 2 THEN won / n_pairs END, 6) AS c_index FROM tot JOIN pairs ON seed = g""",
)
def c_index(t):
    out = survival.concordance(survival_rows(t), ["seed"], "time", "event", "risk", bound=t.rows("events"))
    return out.withColumn("c_index", F.round("c_index", 6))


@query(
    "c_index_by_cohort",
    "WITH " + SURV + ", x AS (SELECT *, seed || '/' || cohort AS sg FROM sv), " + PAIRS.format(g="sg", src="x") + """,
    tot AS (SELECT sg, any_value(seed) AS seed, any_value(cohort) AS cohort, count(*) FILTER (WHERE event) AS n_events FROM x GROUP BY 1)
    SELECT seed, cohort, n_events, round(CASE WHEN n_events >= 5 THEN won / n_pairs END, 6) AS c_index FROM tot JOIN pairs ON sg = g""",
)
def c_index_by_cohort(t):
    out = survival.concordance(
        survival_rows(t), ["seed", "cohort"], "time", "event", "risk", min_events=5, bound=t.rows("events")
    )
    return out.select("seed", "cohort", "n_events", r6(F.col("c_index"), "c_index"))


KM = """
tt AS (SELECT seed, time, count(*) FILTER (WHERE event) AS d, count(*) AS m FROM sv GROUP BY 1, 2),
nn AS (SELECT *, CAST(sum(m) OVER (PARTITION BY seed ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n FROM tt),
km AS (SELECT seed, time, n, d, CASE WHEN sum(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w > 0 THEN 0
   ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS s FROM nn WINDOW w AS (PARTITION BY seed ORDER BY time))
"""


@query("km_curve", "WITH " + SURV + "," + KM + "SELECT seed, time, n AS n_at_risk, d AS n_events, round(s, 6) AS survival FROM km")
def km_curve(t):
    out = survival.survival_curve(survival_rows(t), ["seed"], "time", "event", bound=t.rows("events"))
    return out.withColumn("survival", F.round("survival", 6))


@query("km_median", "WITH " + SURV + "," + KM + "SELECT seed, CAST(coalesce(min(time) FILTER (WHERE s <= 0.5), 90) AS DOUBLE) AS median_time FROM km GROUP BY 1")
def km_median(t):
    curve = survival.survival_curve(survival_rows(t), ["seed"], "time", "event", bound=t.rows("events"))
    return survival.median_survival(curve, ["seed"], 90)


def auc_at_sql(n):
    return f"""u{n} AS (SELECT seed AS scope, CAST(event AND time <= {n} AS INT) AS y, risk AS score FROM sv WHERE (event AND time <= {n}) OR time > {n}),
    a{n} AS (SELECT scope, CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS auc
     FROM (SELECT scope, y, (rank() OVER (PARTITION BY scope ORDER BY score) + (count(*) OVER (PARTITION BY scope, score) - 1) / 2.0) AS rk FROM u{n}) GROUP BY 1),
    c{n} AS (SELECT scope, median(score) AS cut FROM u{n} GROUP BY 1),
    f{n} AS (SELECT scope, CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN 2 * count(*) FILTER (WHERE y = 1 AND score >= cut) /
      (2 * count(*) FILTER (WHERE y = 1 AND score >= cut) + count(*) FILTER (WHERE y = 0 AND score >= cut) + count(*) FILTER (WHERE y = 1 AND score < cut)) END AS f1
      FROM u{n} JOIN c{n} USING (scope) GROUP BY 1)"""


@query(
    "survival_at_horizons",
    "WITH " + SURV + "," + ",".join(auc_at_sql(n) for n in HORIZONS) + """
    SELECT scope AS seed, round(a50.auc, 6) AS auc_at_50, round(f50.f1, 6) AS f1_at_50, round(a60.auc, 6) AS auc_at_60, round(f60.f1, 6) AS f1_at_60,
      round(a70.auc, 6) AS auc_at_70, round(f70.f1, 6) AS f1_at_70
    FROM a50 JOIN f50 USING (scope) JOIN a60 USING (scope) JOIN f60 USING (scope) JOIN a70 USING (scope) JOIN f70 USING (scope)""",
)
def survival_at_horizons(t):
    out = survival.horizon_metrics(survival_rows(t), ["seed"], "time", "event", "risk", HORIZONS, bound=t.rows("events"))
    return out.select("seed", *[r6(F.col(f"{m}_at_{n}"), f"{m}_at_{n}") for n in HORIZONS for m in ("auc", "f1")])


@query(
    "dynamic_auc",
    "WITH " + SURV + """, tr AS (SELECT seed, time, count(*) FILTER (WHERE event) AS d, count(*) FILTER (WHERE NOT event) AS c FROM sv WHERE cohort = 'low' GROUP BY 1, 2),
    te AS (SELECT * FROM sv WHERE cohort = 'high'),
    steps AS (SELECT *, sum(d + c) OVER (PARTITION BY seed ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - d AS n FROM tr),
    w AS (SELECT te.user_id, te.seed, te.risk, te.time, te.event,
      (SELECT CASE WHEN count(*) FILTER (WHERE s.c >= s.n AND s.c > 0) > 0 THEN 0 ELSE coalesce(exp(sum(CASE WHEN s.c > 0 AND s.c < s.n THEN ln((s.n - s.c) / s.n) ELSE 0 END)), 1) END
        FROM steps s WHERE s.seed = te.seed AND s.time <= te.time) AS g FROM te),
    pos AS (SELECT seed, risk, 1 / g AS w FROM w WHERE event AND time <= 60 AND g > 0), neg AS (SELECT seed, risk FROM w WHERE time > 60),
    won AS (SELECT p.seed, sum(p.w * CASE WHEN p.risk > n.risk THEN 1.0 WHEN p.risk = n.risk THEN 0.5 ELSE 0 END) AS x FROM pos p JOIN neg n USING (seed) GROUP BY 1)
    SELECT won.seed, round(x / ((SELECT sum(pos.w) FROM pos WHERE pos.seed = won.seed) * (SELECT count(*) FROM neg WHERE neg.seed = won.seed)), 6) AS dynamic_auc_60 FROM won""",
)
def dynamic_auc(t):
    rows = survival_rows(t)
    out = survival.dynamic_auc(
        rows.where("cohort = 'low'"), rows.where("cohort = 'high'"), ["seed"], "time", "event", "risk", 60, bound=t.rows("events")
    )
    return out.withColumn("dynamic_auc_60", F.round("dynamic_auc_60", 6))


@query(
    "rank_calibration",
    "WITH " + SURV + """, a AS (SELECT seed, user_id, row_number() OVER (PARTITION BY seed ORDER BY -risk, user_id) AS rank FROM sv WHERE event),
    b AS (SELECT seed, time AS calibrated_life, row_number() OVER (PARTITION BY seed ORDER BY time, user_id) AS rank FROM sv WHERE event)
    SELECT seed, user_id, rank, calibrated_life FROM a JOIN b USING (seed, rank)""",
)
def rank_calibration(t):
    rows = survival_rows(t).where("event")
    return ranks.rank_calibration(rows, "seed", "user_id", "risk", "time", bound=t.rows("events"))
