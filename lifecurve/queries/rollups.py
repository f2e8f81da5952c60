"""Queries on metric and prediction roll-ups, snapshots and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifecurve.operators import rollup, survival
from lifecurve.operators.ordered import largest_group
from lifecurve.queries.common import CYC, cycles, r6
from lifecurve.queries.registry import query
from lifecurve.queries.scoring import PAIRS, SURV, survival_rows
from lifecurve.session import materialize
from lifecurve.sources.writers import upsert

# Long metric table: event type plays the model, day the seed.
METRIC = "ml AS (SELECT event_type AS model, day(ts) AS seed, avg(value) AS value FROM events GROUP BY 1, 2)"


def metric_long(t):
    return t.events.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("seed")).agg(
        F.avg("value").alias("value")
    )


@query("seed_rollup", f"WITH {METRIC} SELECT model, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM ml GROUP BY 1")
def seed_rollup(t):
    out = rollup.across_seeds(metric_long(t), ["model"])
    return out.select("model", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "n")


# Per-seed probabilities: seed = event type, p squashes the mean value into (0, 1).
PROBA = "pr AS (SELECT user_id, event_type AS seed, avg(value) / (avg(value) + 40) AS p FROM events GROUP BY 1, 2)"


def seed_probabilities(t):
    m = F.avg("value")
    return t.events.groupBy("user_id", F.col("event_type").alias("seed")).agg((m / (m + 40)).alias("p"))


@query(
    "ensemble_mean",
    f"""WITH {PROBA} SELECT user_id, round(avg(p), 6) AS proba_mean, round(stddev_pop(p), 6) AS proba_std, count(*) AS n_seeds,
     CAST(round(avg(p), 9) > 0.5 AS INT) AS pred, CAST(round(avg(p), 9) >= 0.5 AS INT) AS pred_inclusive FROM pr GROUP BY 1""",
)
def ensemble_mean(t):
    p = seed_probabilities(t)
    strict = rollup.ensemble(p, "user_id", "p")
    loose = rollup.ensemble(p, "user_id", "p", inclusive=True).select("user_id", F.col("pred").alias("pred_inclusive"))
    return strict.join(loose, "user_id").select(
        "user_id", r6(F.col("proba_mean"), "proba_mean"), r6(F.col("proba_std"), "proba_std"), "n_seeds", "pred", "pred_inclusive"
    )


@query(
    "uncertainty_profile",
    f"""WITH {PROBA}, s AS (SELECT user_id, stddev_pop(p) AS sd FROM pr GROUP BY 1)
    SELECT round(avg(sd), 6) AS mean, count(sd) AS n, count(*) FILTER (WHERE sd > 0.1) AS n_over, round(quantile_cont(sd, 0.5), 6) AS p50,
     round(quantile_cont(sd, 0.9), 6) AS p90, round(quantile_cont(sd, 0.99), 6) AS p99 FROM s""",
)
def uncertainty_profile(t):
    spread = rollup.ensemble(seed_probabilities(t), "user_id", "p")
    out = rollup.uncertainty_profile(spread, [], "proba_std", 0.1, bound=t.rows("events"))
    return out.select(r6(F.col("mean"), "mean"), "n", "n_over", *[r6(F.col(c), c) for c in ("p50", "p90", "p99")])


@query(
    "zscore_by_seed",
    f"""WITH {PROBA} SELECT user_id, seed, round((p - avg(p) OVER (PARTITION BY seed)) / stddev_pop(p) OVER (PARTITION BY seed), 6) AS z FROM pr""",
)
def zscore_by_seed(t):
    out = rollup.zscore(seed_probabilities(t), ["seed"], "p", "z", bound=t.rows("events"))
    return out.select("user_id", "seed", r6(F.col("z"), "z"))


# Four models: the first four event types in order; "seed" = cohort.
MODELS = ("click", "error", "purchase", "view")
ALIGNED = (
    SURV
    + """, al AS (SELECT user_id, cohort, time, event, max(risk) FILTER (WHERE seed = 'click') AS r0, max(risk) FILTER (WHERE seed = 'error') AS r1,
      max(risk) FILTER (WHERE seed = 'purchase') AS r2, max(risk) FILTER (WHERE seed = 'view') AS r3 FROM sv GROUP BY 1, 2, 3, 4
      HAVING r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL),
    zz AS (SELECT user_id, cohort, time, event, """
    + ", ".join(f"round((r{i} - avg(r{i}) OVER w) / stddev_pop(r{i}) OVER w, 6) AS z{i}" for i in range(4))
    + " FROM al WINDOW w AS (PARTITION BY cohort))"
)


def aligned_models(t):
    wide = rollup.align_models(survival_rows(t), ["user_id", "cohort", "time", "event"], "seed", "risk", MODELS)
    for i, m in enumerate(MODELS):
        wide = rollup.zscore(wide, ["cohort"], f"score_{m}", f"z{i}", bound=t.rows("events"))
        wide = wide.withColumn(f"z{i}", F.round(f"z{i}", 6))
    return wide.select("user_id", "cohort", "time", "event", "z0", "z1", "z2", "z3")


@query("align_models", "WITH " + ALIGNED + "SELECT user_id, cohort, time, event, z0, z1, z2, z3 FROM zz")
def align_models(t):
    return aligned_models(t)


def blend_scores(t, scores, grid):
    ranked = materialize(survival.time_ranks(materialize(aligned_models(t)), ["cohort"], "time", "event", bound=t.rows("events")))
    # The rows of a cohort, which are few beside the events, bound those of each of its blends.
    most = largest_group(ranked, ["cohort"])[0]
    mixed = rollup.blend(ranked, scores, grid).withColumn("blended", F.round("blended", 6))
    scored = survival.concordance(mixed, ["cohort", "w_no"], "time", "event", "blended", ranked=True, many_keys=True, bound=most)
    return scored.withColumn("w", F.get(rollup.weight_array(grid), F.col("w_no")))


TWO_GRID = [(round(1 - i / 10, 1), i / 10) for i in range(11)]


@query(
    "blend_grid",
    "WITH " + ALIGNED + """, g AS (SELECT i / 10.0 AS w FROM range(11) t(i)),
    x AS (SELECT cohort || '/' || CAST(CAST(w AS DOUBLE) AS VARCHAR) AS cg, cohort, CAST(w AS DOUBLE) AS w, time, event, round(CAST(1 - w AS DOUBLE) * z0 + CAST(w AS DOUBLE) * z1, 6) AS risk FROM zz, g),
    """ + PAIRS.format(g="cg", src="x") + """,
    c AS (SELECT cohort, w, won / n_pairs AS c FROM (SELECT DISTINCT cg, cohort, w FROM x) JOIN pairs ON cg = g),
    a AS (SELECT w, avg(c) AS m, stddev_samp(c) AS s FROM c GROUP BY 1)
    SELECT w, round(m, 6) AS mean, round(s, 6) AS std FROM a""",
)
def blend_grid(t):
    scored = blend_scores(t, ["z0", "z1"], TWO_GRID).withColumn("w", F.get(F.col("w"), 1))
    return scored.groupBy("w").agg(
        F.round(F.avg("c_index"), 6).alias("mean"), F.round(F.stddev_samp("c_index"), 6).alias("std")
    )


@query(
    "blend_verdict",
    "WITH " + ALIGNED + """, g AS (SELECT i / 10.0 AS w FROM range(11) t(i)),
    x AS (SELECT cohort || '/' || CAST(CAST(w AS DOUBLE) AS VARCHAR) AS cg, cohort, CAST(w AS DOUBLE) AS w, time, event, round(CAST(1 - w AS DOUBLE) * z0 + CAST(w AS DOUBLE) * z1, 6) AS risk FROM zz, g),
    """ + PAIRS.format(g="cg", src="x") + """,
    c AS (SELECT cohort, w, won / n_pairs AS c FROM (SELECT DISTINCT cg, cohort, w FROM x) JOIN pairs ON cg = g),
    a AS (SELECT w, avg(c) AS m, stddev_samp(c) AS s FROM c GROUP BY 1),
    b AS (SELECT arg_max(w, m) AS bw, max(m) AS bm, arg_max(s, m) AS bs, max(m) FILTER (WHERE w = 0) AS f, max(m) FILTER (WHERE w = 1) AS se FROM a)
    SELECT bw AS best_weight, round(bm, 6) AS best_mean, round(bs, 6) AS best_std, round(f, 6) AS first_alone, round(se, 6) AS second_alone,
     round(bm - greatest(f, se), 6) AS delta, CASE WHEN bw NOT IN (0, 1) AND bm - greatest(f, se) > bs THEN 'blend wins' WHEN bw = 1 THEN 'second alone'
       WHEN bw = 0 THEN 'first alone' ELSE 'blend nudges' END AS verdict FROM b""",
)
def blend_verdict(t):
    scored = blend_scores(t, ["z0", "z1"], TWO_GRID).withColumn("w", F.get(F.col("w"), 1))
    out = rollup.blend_summary(scored)
    rounded = ["best_mean", "best_std", "first_alone", "second_alone", "delta"]
    return out.select("best_weight", *[r6(F.col(c), c) for c in rounded], "verdict")


FOUR_GRID = rollup.simplex(4, 10)


@query(
    "simplex_best",
    "WITH " + ALIGNED + """, r AS (SELECT i FROM range(11) t(i)),
    g AS (SELECT a.i / 10::DOUBLE AS a, b.i / 10::DOUBLE AS b, c.i / 10::DOUBLE AS c, d.i / 10::DOUBLE AS d,
       lpad(CAST(((a.i * 11 + b.i) * 11 + c.i) * 11 + d.i AS VARCHAR), 6, '0') AS gid FROM r a, r b, r c, r d WHERE a.i + b.i + c.i + d.i = 10),
    x AS (SELECT cohort || gid AS cg, cohort, gid, time, event, round(0.0::DOUBLE + a * z0 + b * z1 + c * z2 + d * z3, 6) AS risk FROM zz, g),
    """ + PAIRS.format(g="cg", src="x") + """,
    s AS (SELECT gid, avg(won / n_pairs) AS m, stddev_pop(won / n_pairs) AS sd FROM (SELECT DISTINCT cg, gid FROM x) JOIN pairs ON cg = g GROUP BY 1)
    SELECT a AS w_0, b AS w_1, c AS w_2, d AS w_3, round(m, 6) AS c_mean, round(sd, 6) AS c_std FROM s JOIN g USING (gid)
    ORDER BY round(m, 6) DESC, a DESC, b DESC, c DESC LIMIT 10""",
)
def simplex_best(t):
    scored = blend_scores(t, ["z0", "z1", "z2", "z3"], FOUR_GRID)
    agg = scored.groupBy("w_no").agg(
        F.first("w").alias("w"), F.round(F.avg("c_index"), 6).alias("c_mean"), F.round(F.stddev_pop("c_index"), 6).alias("c_std")
    )
    wide = agg.select(*[F.get(F.col("w"), i).alias(f"w_{i}") for i in range(4)], "c_mean", "c_std")
    order = [F.col("c_mean").desc(), *[F.col(f"w_{i}").desc() for i in range(3)]]
    return rollup.top_rows(wide, order, 10)


@query(
    "importance_rollup",
    "SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, count(*) AS n FROM part GROUP BY 1 ORDER BY 2",
)
def importance_rollup(t):
    out = rollup.importance_rollup(t.part.withColumnRenamed("p_brand", "feature"), "feature", "p_retailprice")
    return out.select("feature", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "n").orderBy("mean")


ATTR = "w AS (SELECT event_type AS seed, user_id, avg(value) - 50 AS f_value, avg(CAST(json_extract_string(props, '$.k') AS BIGINT)) - 50 AS f_k, count(*)::DOUBLE AS f_n FROM events GROUP BY 1, 2)"


def attribution_wide(t):
    df = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return df.groupBy(F.col("event_type").alias("seed"), "user_id").agg(
        (F.avg("value") - 50).alias("f_value"), (F.avg("k") - 50).alias("f_k"), F.count(F.lit(1)).cast("double").alias("f_n")
    )


@query("attribution_long", f"WITH {ATTR} SELECT seed, user_id, feature, round(value, 6) AS value FROM w UNPIVOT (value FOR feature IN (f_value, f_k, f_n))")
def attribution_long(t):
    out = rollup.attribution_long(attribution_wide(t), ["seed", "user_id"], ["f_value", "f_k", "f_n"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "attribution_rollup",
    f"""WITH {ATTR}, l AS (SELECT seed, feature, avg(abs(value)) AS a FROM w UNPIVOT (value FOR feature IN (f_value, f_k, f_n)) GROUP BY 1, 2)
    SELECT feature, round(avg(a), 6) AS mean_abs, round(coalesce(stddev_samp(a), 0), 6) AS std_abs, count(*) AS n_seeds FROM l GROUP BY 1""",
)
def attribution_rollup(t):
    long = rollup.attribution_long(attribution_wide(t), ["seed", "user_id"], ["f_value", "f_k", "f_n"])
    out = rollup.attribution_rollup(long, "seed", "feature", "value")
    return out.select("feature", r6(F.col("mean_abs"), "mean_abs"), r6(F.col("std_abs"), "std_abs"), "n_seeds")


@query(
    "set_fingerprint",
    """WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(('0x' || substring(md5(name), 1, 15))::BIGINT) AS a, sum(('0x' || substring(md5(name), 16, 15))::BIGINT) AS b
    FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR) AS name FROM orders) GROUP BY 1, 2)
    SELECT o_orderpriority, o_orderstatus, n, substring(sha256(n || '/' || a || '/' || b), 1, 16) AS fingerprint FROM s""",
)
def set_fingerprint(t):
    return rollup.set_fingerprint(t.orders, ["o_orderpriority", "o_orderstatus"], "o_custkey")


@query(
    "split_check",
    """WITH x AS (SELECT o_orderstatus, o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS tr, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS te FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, CAST(sum(tr) AS BIGINT) AS n_train, CAST(sum(te) AS BIGINT) AS n_test, count(*) FILTER (WHERE tr > 0 AND te > 0) AS n_leaked,
      count(*) FILTER (WHERE tr > 1 OR te > 1) AS n_duplicated FROM x GROUP BY 1""",
)
def split_check(t):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return rollup.split_check(t.orders.where(urgent), t.orders.where(~urgent), ["o_orderstatus"], "o_custkey")


@query(
    "same_test_sets",
    """WITH a AS (SELECT c_mktsegment, count(*) n, list_sort(list(c_custkey)) s FROM customer GROUP BY 1),
    b AS (SELECT c_mktsegment, count(*) n, list_sort(list(c_custkey)) s FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1)
    SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, a.n AS n_a, b.n AS n_b, coalesce(a.s = b.s, false) AS same FROM a FULL JOIN b USING (c_mktsegment)""",
)
def same_test_sets(t):
    active = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return rollup.same_sets(t.customer, active, ["c_mktsegment"], "c_custkey")


@query(
    "param_mode_median",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2),
    m AS (SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1),
    d AS (SELECT p_brand, median(p_size) AS p_size FROM part GROUP BY 1) SELECT p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size FROM m JOIN d USING (p_brand)""",
)
def param_mode_median(t):
    return rollup.representative(t.part, ["p_brand"], "p_partkey", ["p_size"], ["p_type"], bound=t.rows("part"))


@query(
    "param_spread",
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2),
    m AS (SELECT p_brand, p_size AS mode FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)
    SELECT p_brand, count(DISTINCT p_size) AS n_unique, min(p_size) AS low, max(p_size) AS high, any_value(mode) AS mode, CAST(median(p_size) AS DOUBLE) AS median
    FROM part JOIN m USING (p_brand) GROUP BY 1""",
)
def param_spread(t):
    return rollup.parameter_spread(t.part, ["p_brand"], "p_size", "p_partkey", bound=t.rows("part"))


@query(
    "feature_summary",
    """SELECT c_mktsegment, feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n FROM
    (SELECT c_mktsegment, 'c_acctbal' AS feature, c_acctbal AS v FROM customer UNION ALL SELECT c_mktsegment, 'c_nationkey', c_nationkey FROM customer) GROUP BY 1, 2""",
)
def feature_summary(t):
    df = t.customer.withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    out = rollup.feature_summary(df, "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return out.select("c_mktsegment", "feature", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "n")


@query(
    "missing_counts",
    """WITH x AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'doc_id' AS "column", count(*) AS n_rows, count(*) - count(doc_id) AS n_missing FROM x UNION ALL
    SELECT 'quality', count(*), count(*) - count(quality) FROM x UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic) FROM x""",
)
def missing_counts(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rollup.missing_counts(df, ["doc_id", "quality", "toxic"])


@query(
    "describe_columns",
    """SELECT col AS "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
      round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75 FROM
    (SELECT 'l_quantity' AS col, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1""",
)
def describe_columns(t):
    out = rollup.describe_columns(t.lineitem, ["l_quantity", "l_extendedprice"], bound=t.rows("lineitem"))
    return out.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


@query(
    "metric_pivot",
    """WITH m AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS yr, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
    SELECT o_orderpriority, yr, round(avg(v) FILTER (WHERE o_orderstatus = 'F'), 4) AS "F", round(avg(v) FILTER (WHERE o_orderstatus = 'O'), 4) AS "O",
      round(avg(v) FILTER (WHERE o_orderstatus = 'F') - avg(v) FILTER (WHERE o_orderstatus = 'O'), 4) AS delta FROM m GROUP BY 1, 2""",
)
def metric_pivot(t):
    m = t.orders.groupBy("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("long").alias("yr")).agg(
        F.avg("o_totalprice").alias("v")
    )
    out = rollup.pivot_delta(m, ["o_orderpriority", "yr"], "o_orderstatus", "F", "O", "v")
    return out.select("o_orderpriority", "yr", *[F.round(c, 4).alias(c) for c in ("F", "O", "delta")])


@query(
    "wide_to_long",
    """SELECT l_shipmode, metric, round(value, 4) AS value FROM (SELECT l_returnflag AS l_shipmode, avg(l_quantity) AS test_qty, avg(l_discount) AS test_disc, count(*)::DOUBLE AS n_rows FROM lineitem GROUP BY 1)
    UNPIVOT (value FOR metric IN (test_qty, test_disc, n_rows))""",
)
def wide_to_long(t):
    wide = t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(
        F.avg("l_quantity").alias("test_qty"), F.avg("l_discount").alias("test_disc"), F.count(F.lit(1)).alias("n_rows")
    )
    out = rollup.wide_to_long(wide, ["l_shipmode"], ["test_qty", "test_disc", "n_rows"])
    return out.withColumn("value", F.round("value", 4))


@query(
    "improvement_pct",
    """WITH a AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(b, 4) AS base_value, round(o, 4) AS other_value, round(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN -1 ELSE 1 END * (o - b) / b * 100, 6) AS improvement_pct FROM a""",
)
def improvement_pct(t):
    df = t.orders.withColumn("lower", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    out = rollup.improvement_pct(df, ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice", "lower")
    return out.select(
        "o_orderpriority",
        F.round("base_value", 4).alias("base_value"),
        F.round("other_value", 4).alias("other_value"),
        r6(F.col("improvement_pct"), "improvement_pct"),
    )


# Paired metrics: supplier = seed, ship year = level.
PAIRED = """lv AS (SELECT l_suppkey AS seed, year(l_shipdate) AS lvl, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
pd AS (SELECT a.seed, a.lvl AS big, b.lvl AS small, m.metric, (CASE m.metric WHEN 'disc' THEN a.disc - b.disc ELSE a.tax - b.tax END) * 100 AS delta
  FROM lv a JOIN lv b ON a.seed = b.seed AND a.lvl > b.lvl CROSS JOIN (VALUES ('disc'), ('tax')) m(metric))"""


def paired(t):
    lv = t.lineitem.groupBy(F.col("l_suppkey").alias("seed"), F.year("l_shipdate").cast("long").alias("lvl")).agg(
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")
    )
    return rollup.paired_deltas(lv, "seed", "lvl", ["disc", "tax"])


@query(
    "paired_deltas",
    f"""WITH {PAIRED} SELECT big, small, metric, count(delta) AS n_seeds, round(avg(delta), 6) AS delta_pp, round(avg(delta) / stddev_samp(delta) * sqrt(count(delta)), 6) AS t_stat,
     round(avg(delta) / stddev_samp(delta), 6) AS cohens_d, 'different entity pools per level (paired only on seed)' AS note FROM pd GROUP BY 1, 2, 3""",
)
def paired_deltas(t):
    out = rollup.paired_summary(paired(t))
    return out.select("big", "small", "metric", "n_seeds", *[r6(F.col(c), c) for c in ("delta_pp", "t_stat", "cohens_d")], "note")


# Student's distribution for whole degrees of freedom v as a finite sum in the cosine of atan(|t| / sqrt(v)).
@query(
    "paired_p_values",
    f"""WITH {PAIRED}, ts AS (SELECT big, small, metric, avg(delta) / stddev_samp(delta) * sqrt(count(delta)) AS t, count(delta) - 1 AS v FROM pd GROUP BY 1, 2, 3),
    an AS (SELECT *, atan(abs(t) / sqrt(v)) AS a FROM ts),
    terms AS (SELECT *, CASE WHEN v % 2 = 1 THEN [coalesce(list_aggregate([2.0::DOUBLE * i / (2 * i + 1) FOR i IN range(1, j)], 'product'), 1) * cos(a) ** (2 * j - 1) FOR j IN range(1, (v - 1) // 2 + 1)]
      ELSE [coalesce(list_aggregate([(2 * i - 1)::DOUBLE / (2 * i) FOR i IN range(1, j + 1)], 'product'), 1) * cos(a) ** (2 * j) FOR j IN range(0, v // 2)] END AS ks FROM an)
    SELECT big, small, metric, round(greatest(1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (a + sin(a) * coalesce(list_sum(ks), 0)) ELSE sin(a) * list_sum(ks) END, 0), 6) AS p_value FROM terms""",
)
def paired_p_values(t):
    out = rollup.paired_summary(paired(t))
    p = rollup.student_p_value(F.col("t_stat"), F.col("n_seeds") - 1)
    return out.select("big", "small", "metric", F.round(p, 6).alias("p_value"))


@query(
    "bootstrap_ci",
    # Keys of up to 4,096 rows are one block, which draws by the hash alone; beyond that SQL has no binomial cuts.
    f"""WITH {PAIRED}, r AS (SELECT big, small, metric, row_number() OVER w AS i, list(delta) OVER w AS ds, count(*) OVER (PARTITION BY big, small, metric) AS n FROM pd WHERE delta IS NOT NULL WINDOW w AS (PARTITION BY big, small, metric ORDER BY seed)),
    k AS (SELECT big, small, metric, n, ds, CAST('0x' || substring(md5(big || '/' || small || '/' || metric || '/20260514'), 1, 7) AS BIGINT) AS mark FROM r WHERE i = n),
    x1 AS (SELECT k.*, rep, (rep * 1103515245 + mark) % 2147483647 AS x FROM k, range(1, 10001) t(rep)),
    x2 AS (SELECT big, small, metric, n, ds, rep, slot, (xor(x, x >> 13) * 1664525 + slot) % 2147483647 AS x FROM x1, LATERAL (SELECT unnest(range(1, n + 1)) AS slot) u),
    x3 AS (SELECT * REPLACE ((xor(x, x >> 17) * 48271 + 1) % 2147483647 AS x) FROM x2),
    m AS (SELECT big, small, metric, rep, avg(ds[(xor(x, x >> 11) * 1103515245) % 2147483647 % n + 1]) AS mean FROM x3 GROUP BY 1, 2, 3, 4)
    SELECT big, small, metric, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM m GROUP BY 1, 2, 3""",
)
def bootstrap_ci(t):
    out = rollup.bootstrap_mean_ci(
        paired(t), ["big", "small", "metric"], "delta", ["seed"], bound=t.rows("lineitem")
    )
    return out.select("big", "small", "metric", r6(F.col("ci_lo"), "ci_lo"), r6(F.col("ci_hi"), "ci_hi"))


# Two snapshots of the customers: the second follows from their orders.
SNAP = """ref AS (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal > 0 AS solvent, c_nationkey < 12 AS near FROM customer),
spent AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY 1),
new AS (SELECT c_custkey, CASE WHEN n > 12 THEN NULL WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  c_acctbal > coalesce(n, 0) * 100 AS solvent, c_nationkey < 12 AS near FROM customer LEFT JOIN spent ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 9)"""


def snapshots(t):
    ref = t.customer.select(
        "c_custkey",
        "c_acctbal",
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
        (F.col("c_acctbal") > 0).alias("solvent"),
        (F.col("c_nationkey") < 12).alias("near"),
    )
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    new = (
        ref.join(spent, "c_custkey", "left")
        .where(F.coalesce(n, F.lit(0)) != 9)
        .select(
            "c_custkey",
            F.when(n > 12, None).when(n.isNull(), F.col("c_acctbal")).otherwise(F.col("c_acctbal") + n).alias("c_acctbal"),
            "c_nationkey",
            (F.col("c_acctbal") > F.coalesce(n, F.lit(0)) * 100).alias("solvent"),
            "near",
        )
    )
    return new, ref


@query("snapshot_join", f"WITH {SNAP} SELECT c_custkey, new.c_acctbal AS c_acctbal_new, ref.c_acctbal AS c_acctbal_ref FROM new FULL JOIN ref USING (c_custkey)")
def snapshot_join(t):
    new, ref = snapshots(t)
    return rollup.snapshot_join(new, ref, "c_custkey", ["c_acctbal"])


@query(
    "snapshot_diff",
    f"""WITH {SNAP}, j AS (SELECT 'c_acctbal' AS "column", new.c_acctbal AS a, ref.c_acctbal AS b FROM new JOIN ref USING (c_custkey) UNION ALL
      SELECT 'c_nationkey', new.c_nationkey, ref.c_nationkey FROM new JOIN ref USING (c_custkey))
    SELECT "column", count(*) FILTER (WHERE (a IS NULL AND b IS NULL) OR abs(a - b) <= 1e-6) AS n_identical, count(*) FILTER (WHERE abs(a - b) > 1e-6) AS n_diff,
      round(coalesce(max(abs(a - b)) FILTER (WHERE abs(a - b) > 1e-6), 0), 6) AS max_abs_diff, round(coalesce(avg(abs(a - b)) FILTER (WHERE abs(a - b) > 1e-6), 0), 6) AS mean_abs_diff,
      count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS n_missing_flip FROM j GROUP BY 1""",
)
def snapshot_diff(t):
    new, ref = snapshots(t)
    out = rollup.snapshot_diff(new, ref, "c_custkey", ["c_acctbal", "c_nationkey"])
    return out.select(
        "column", "n_identical", "n_diff", r6(F.col("max_abs_diff"), "max_abs_diff"), r6(F.col("mean_abs_diff"), "mean_abs_diff"), "n_missing_flip"
    )


@query(
    "flag_changes",
    f"""WITH {SNAP} SELECT 'solvent' AS flag, count(*) FILTER (WHERE new.solvent <> ref.solvent) AS n_changed FROM new JOIN ref USING (c_custkey)
    UNION ALL SELECT 'near', count(*) FILTER (WHERE new.near <> ref.near) FROM new JOIN ref USING (c_custkey)""",
)
def flag_changes(t):
    new, ref = snapshots(t)
    return rollup.flag_changes(new, ref, "c_custkey", ["solvent", "near"])


@query(
    "snapshot_upsert",
    f"WITH {SNAP} SELECT c_custkey, CASE WHEN new.c_custkey IS NOT NULL THEN new.c_acctbal ELSE ref.c_acctbal END AS c_acctbal FROM ref FULL JOIN new USING (c_custkey)".replace(
        "CASE WHEN new.c_custkey IS NOT NULL", "CASE WHEN new.near IS NOT NULL"
    ),
)
def snapshot_upsert(t):
    new, ref = snapshots(t)
    return upsert(ref.select("c_custkey", "c_acctbal"), new.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query(
    "pass_rates",
    """WITH a AS (SELECT avg(CAST(n_chars > 500 AS DOUBLE)) AS p5, avg(CAST(n_chars > 1000 AS DOUBLE)) AS p10, avg(CAST(n_chars > 2000 AS DOUBLE)) AS p20 FROM documents)
    SELECT 500 AS horizon, round(p5, 6) AS pass_rate, CAST(NULL AS BOOLEAN) AS not_rising FROM a UNION ALL SELECT 1000, round(p10, 6), p10 <= p5 FROM a UNION ALL SELECT 2000, round(p20, 6), p20 <= p10 FROM a""",
)
def pass_rates(t):
    df = t.documents.select(*[(F.col("n_chars") > n).alias(f"pass_n{n}") for n in (500, 1000, 2000)])
    return rollup.pass_rates(df, (500, 1000, 2000)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(
    "latest_per_config",
    """SELECT o_orderpriority, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_per_config(t):
    out = rollup.latest_per(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderdate", "o_orderkey")
    return out.select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")


@query(
    "topk_per_group",
    """SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def topk_per_group(t):
    df = t.part.select("p_brand", "p_name", "p_partkey")
    return rollup.first_k_per_group(df, ["p_brand"], ["p_name", "p_partkey"], 3, bound=t.rows("part"))


@query(
    "topk_per_category",
    """WITH c AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n, coalesce(spent, 0) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, sum(o_totalprice) spent FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    p AS (SELECT * FROM (SELECT c_custkey, 0 AS i, 'richest' AS category, round(c_acctbal, 2) AS sort_key FROM c WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
      UNION ALL SELECT * FROM (SELECT c_custkey, 1, 'top_spender', round(spent, 2) FROM c ORDER BY round(spent, 2) DESC, c_custkey LIMIT 5)
      UNION ALL SELECT * FROM (SELECT c_custkey, 2, 'deepest_debt', round(-c_acctbal, 2) FROM c WHERE c_acctbal < 0 ORDER BY -c_acctbal DESC, c_custkey LIMIT 5)
      UNION ALL SELECT * FROM (SELECT c_custkey, 3, 'most_orders', CAST(n AS DOUBLE) FROM c ORDER BY n DESC, c_custkey LIMIT 5))
    SELECT c_custkey, category, sort_key FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS rn FROM p) WHERE rn = 1""",
)
def topk_per_category(t):
    agg = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    c = t.customer.join(agg, "c_custkey", "left").fillna(0, ["n", "spent"])
    bal = F.col("c_acctbal")
    return rollup.categorized_picks(
        c,
        "c_custkey",
        [
            ("richest", bal > 0, bal, 5),
            ("top_spender", F.lit(True), F.col("spent"), 5),
            ("deepest_debt", bal < 0, -bal, 5),
            ("most_orders", F.lit(True), F.col("n"), 5),
        ],
    )


@query(
    "primary_candidate",
    "WITH " + CYC + """, e AS (SELECT user_id, min(cycle) AS cycle, count(*) - 1 AS n_extra FROM cyc WHERE event_type = 'error' GROUP BY 1)
    SELECT e.user_id, e.cycle, c.value, n_extra FROM e JOIN cyc c ON c.user_id = e.user_id AND c.cycle = e.cycle""",
)
def primary_candidate(t):
    errors = cycles(t, "event_type").rows().where("event_type = 'error'").select("user_id", "cycle", "value")
    return rollup.primary_candidate(errors, "user_id", "cycle")


@query(
    "nth_event",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 2""",
)
def nth_event(t):
    from lifecurve.operators.series import nth_event as nth

    df = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return nth(df, "user_id", ["ts", "event_id"], 2, bound=t.rows("events")).drop("ts")


@query(
    "max_abs_gap",
    """SELECT round(max(abs(o_totalprice - s)), 4) AS max_abs_gap, count(*) AS n FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def max_abs_gap(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("recomputed")
    )
    out = rollup.max_abs_gap(t.orders.select("o_orderkey", "o_totalprice"), sums, ["o_orderkey"], "o_totalprice", "recomputed")
    return out.withColumn("max_abs_gap", F.round("max_abs_gap", 4))
