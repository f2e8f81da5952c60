"""Queries on labelings, human decisions, the review queue and readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifecurve.functions import scalars
from lifecurve.operators import audit, rollup, series
from lifecurve.queries.common import CYC, HORIZONS, cycles, r6
from lifecurve.queries.label_stack import LABELS, LABEL_HORIZONS, cell_inputs, label_rows
from lifecurve.queries.registry import query
from lifecurve.sources import readers

# Our label of a document follows from its length; their verdict is the quality flag.
OURS = """ours AS (SELECT doc_id, lang, source, n_chars, CASE WHEN lang = 'de' AND n_chars > 20000 THEN 'excluded' WHEN n_chars < 300 THEN 'censor' WHEN n_chars >= 1200 THEN 'pass' ELSE 'bad' END AS label FROM documents),
theirs AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS verdict FROM labels),
cat AS (SELECT o.*, verdict, CASE WHEN label = 'excluded' THEN 'ours_excluded' WHEN label = 'censor' THEN 'ours_censor'
  WHEN label = 'pass' AND verdict = 'good' THEN 'agree_pass' WHEN label = 'bad' AND verdict = 'bad' THEN 'agree_bad'
  WHEN label = 'pass' AND verdict = 'bad' THEN 'disagree_we_pass_they_bad' WHEN label = 'bad' AND verdict = 'good' THEN 'disagree_we_bad_they_pass' ELSE 'unknown' END AS category
  FROM ours o JOIN theirs USING (doc_id))"""


def our_labels(t):
    n = F.col("n_chars")
    label = (
        F.when((F.col("lang") == "de") & (n > 20000), "excluded")
        .when(n < 300, "censor")
        .when(n >= 1200, "pass")
        .otherwise("bad")
    )
    return t.documents.select("doc_id", "lang", "source", "n_chars", label.alias("label"))


def their_labels(t):
    verdict = F.when(F.col("quality") == 1, "GOOD").otherwise("BAD")
    return readers.read_second_labels(
        t.labels.withColumn("v", verdict), {"doc_id": "doc_id", "v": "verdict"}, lower=["verdict"]
    )


def categorized(t):
    both, _ = audit.matched_and_other(their_labels(t), our_labels(t), "doc_id")
    return both.withColumn("category", audit.agreement_category(F.col("label"), F.col("verdict")))


@query("agreement_category", f"WITH {OURS} SELECT doc_id, lang, label, verdict, category FROM cat")
def agreement_category(t):
    return categorized(t).select("doc_id", "lang", "label", "verdict", "category")


@query(
    "category_counts",
    f"WITH {OURS}, d(category) AS (VALUES ('agree_pass'), ('agree_bad'), ('disagree_we_pass_they_bad'), ('disagree_we_bad_they_pass'), ('ours_censor'), ('ours_excluded')) SELECT d.category, count(cat.doc_id) AS n FROM d LEFT JOIN cat USING (category) GROUP BY 1",
)
def category_counts(t):
    return audit.category_counts(categorized(t), "category")


@query(
    "confusion_long",
    f"""WITH {OURS}, d AS (SELECT l.lang, v.verdict, o.label FROM (SELECT DISTINCT lang FROM cat) l, (VALUES ('good'), ('bad')) v(verdict), (VALUES ('pass'), ('bad'), ('censor'), ('excluded')) o(label))
    SELECT d.lang, d.verdict, d.label, count(cat.doc_id) AS n FROM d LEFT JOIN cat ON cat.lang = d.lang AND cat.verdict = d.verdict AND cat.label = d.label GROUP BY 1, 2, 3""",
)
def confusion_long(t):
    return audit.confusion_long(
        categorized(t), "verdict", "label", ("good", "bad"), ("pass", "bad", "censor", "excluded"), ["lang"]
    )


@query(
    "agreement_by_cohort",
    f"""WITH {OURS}, a AS (SELECT coalesce(lang, 'all') AS scope, count(*) AS n_total, count(*) FILTER (WHERE category NOT LIKE 'ours%') AS n_primary,
      count(*) FILTER (WHERE category LIKE 'agree%') AS n_agree FROM cat GROUP BY GROUPING SETS ((), (lang)))
    SELECT scope, n_total, n_primary, n_agree, n_primary - n_agree AS n_disagree, round(n_agree / nullif(n_primary, 0), 6) AS agreement FROM a""",
)
def agreement_by_cohort(t):
    out = audit.agreement_summary(categorized(t), "category", "lang")
    return out.withColumn("agreement", F.round("agreement", 6))


@query(
    "matched_and_other",
    """SELECT doc_id, true AS matched, n_chars FROM labels JOIN documents USING (doc_id) UNION ALL
    SELECT doc_id, false, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def matched_and_other(t):
    both, other = audit.matched_and_other(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id"), "doc_id")
    return both.withColumn("matched", F.lit(True)).unionByName(other.withColumn("matched", F.lit(False)))


@query(
    "spine_merge",
    """SELECT c.c_custkey, n_name, n_orders, round(spent, 2) AS spent FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c.c_custkey
    LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c.c_custkey""",
)
def spine_merge(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    n = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    spent = orders.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    where = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return audit.spine_merge(t.customer.select("c_custkey"), [where, n, spent], "c_custkey")


@query(
    "join_with_missing_count",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_missing FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def join_with_missing_count(t):
    return audit.join_with_missing_count(t.documents.select("doc_id"), t.labels, "doc_id")[1]


@query(
    "overlap_sets",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
    SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
    SELECT 'only_orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""",
)
def overlap_sets(t):
    a = t.customer.select("c_custkey")
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"))

    def size(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")

    return (
        size(audit.in_both(a, b, "c_custkey"), "both")
        .unionByName(size(audit.only_in(a, b, "c_custkey"), "only_customers"))
        .unionByName(size(audit.only_in(b, a, "c_custkey"), "only_orders"))
    )


@query("restrict_to", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def restrict_to(t):
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return audit.restrict_to(t.orders.select("o_orderkey", "o_custkey"), wanted, "o_custkey")


# Early values of each user against the mean of the user's clicks.
CAND = CYC + """, m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS ref, max(value) FILTER (WHERE cycle = 1) AS v_c1,
  max(value) FILTER (WHERE cycle = 2) AS v_c2, max(value) FILTER (WHERE cycle = 5) AS v_c5, avg(value) AS v_mean FROM cyc GROUP BY 1),
  l AS (SELECT ref, candidate, v FROM m UNPIVOT (v FOR candidate IN (v_c1, v_c2, v_c5, v_mean)))"""


def candidate_rows(t):
    c = cycles(t, "event_type").rows()
    ref = c.groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("ref"), F.avg("value").alias("v_mean")
    )
    return ref.join(series.value_at_ordinals(c, "user_id", "cycle", {"v": "value"}, [1, 2, 5]), "user_id")


CANDIDATES = ["v_c1", "v_c2", "v_c5", "v_mean"]


@query(
    "difference_profile",
    "WITH " + CAND + """SELECT candidate, count(ref - v) AS n, round(avg(ref - v), 6) AS mean_diff, round(stddev_samp(ref - v), 6) AS std_diff,
    round(max(abs(ref - v)), 6) AS max_abs_diff, round(avg(abs(ref - v)), 6) AS mean_abs_diff, count(*) FILTER (WHERE abs(ref - v) > 0.01) AS n_over FROM l GROUP BY 1""",
)
def difference_profile(t):
    out = audit.difference_profile(candidate_rows(t), "ref", CANDIDATES)
    rounded = ["mean_diff", "std_diff", "max_abs_diff", "mean_abs_diff"]
    return out.select("candidate", "n", *[r6(F.col(c), c) for c in rounded], "n_over")


@query(
    "best_candidate",
    "WITH " + CAND + ", p AS (SELECT candidate, avg(abs(ref - v)) AS s FROM l GROUP BY 1) SELECT arg_min(candidate, s) AS best_candidate, round(min(s), 6) AS best_mean_abs_diff FROM p",
)
def best_candidate(t):
    profile = audit.difference_profile(candidate_rows(t), "ref", CANDIDATES)
    out = audit.best_candidate(profile, "mean_abs_diff")
    return out.withColumn("best_mean_abs_diff", F.round("best_mean_abs_diff", 6))


@query(
    "correlation_profile",
    "WITH " + CAND + """SELECT candidate, count(*) AS n, round(corr(ref, v), 6) AS r, round(avg(abs(ref - v)), 6) AS mean_abs, round(avg(ref - v), 6) AS bias
    FROM l WHERE ref IS NOT NULL AND v IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""",
)
def correlation_profile(t):
    out = audit.correlation_profile(candidate_rows(t), "ref", CANDIDATES)
    return out.select("candidate", "n", *[r6(F.col(c), c) for c in ("r", "mean_abs", "bias")])


@query(
    "value_at_ordinals",
    "WITH " + CYC + "SELECT user_id, max(value) FILTER (WHERE cycle = 1) AS v_c1, max(k) FILTER (WHERE cycle = 1) AS k_c1, max(value) FILTER (WHERE cycle = 5) AS v_c5, max(k) FILTER (WHERE cycle = 5) AS k_c5 FROM cyc GROUP BY 1",
)
def value_at_ordinals(t):
    return series.value_at_ordinals(cycles(t, "k").rows(), "user_id", "cycle", {"v": "value", "k": "k"}, [1, 5])


# Review: decisions carry the cycle of the user's last purchase as the recorded count.
REVIEW = (
    LABELS
    + """,
dec AS (SELECT d.user_id, d.exclude_from_ml, d.last_available_cycle, CASE d.event_type WHEN 'censor' THEN 'pause' ELSE d.event_type END AS event_type,
   p.protocol_pattern AS reason, CASE WHEN p.first_regime_n > 14 THEN NULL ELSE '2024-02-01' END AS validated_at,
   CASE WHEN p.first_regime_n > 13 THEN NULL WHEN p.first_regime_n > 11 THEN f.n_full ELSE d.last_available_cycle END AS recorded
   FROM decisions d JOIN cells p USING (user_id) JOIN facts f USING (user_id)),
cur AS (SELECT user_id, n_full FROM facts WHERE base > 2),
stale AS (SELECT d.user_id, 'decided at ' || coalesce(CAST(recorded AS VARCHAR), 'unrecorded') || ' cycles, now ' || coalesce(CAST(n_full AS VARCHAR), 'none') AS stale_reason
   FROM dec d LEFT JOIN cur USING (user_id) WHERE recorded IS NULL OR n_full IS NULL OR recorded <> n_full),
tail AS (SELECT o.user_id, count(*) AS n_tail, string_agg(CAST(o.cycle AS VARCHAR), ',' ORDER BY o.cycle) AS tail_cycles
   FROM outl o JOIN cur c ON o.user_id = c.user_id AND o.cycle BETWEEN c.n_full - 4 AND c.n_full GROUP BY 1),
flag AS (SELECT DISTINCT user_id FROM fd WHERE lf >= 60)
"""
)


def review_inputs(t):
    """(decisions, current counts, outliers, flagged) for the review queue."""
    cells, meas, decisions, outliers = cell_inputs(t)
    full = meas.groupBy("user_id").agg(
        F.max("cycle").alias("n_full"), F.max(F.when(F.col("cycle") == 1, F.col("dis"))).alias("base")
    )
    n = F.col("first_regime_n")
    dec = (
        decisions.join(cells.select("user_id", "protocol_pattern", "first_regime_n"), "user_id")
        .join(full, "user_id")
        .select(
            "user_id",
            "exclude_from_ml",
            "last_available_cycle",
            F.when(F.col("event_type") == "censor", "pause").otherwise(F.col("event_type")).alias("event_type"),
            F.col("protocol_pattern").alias("reason"),
            F.when(n <= 14, "2024-02-01").alias("validated_at"),
            F.when(n > 13, None).when(n > 11, F.col("n_full")).otherwise(F.col("last_available_cycle")).alias("recorded"),
        )
    )
    return dec, full.where("base > 2").select("user_id", "n_full"), outliers


@query(
    "decision_rule_errors",
    "WITH " + REVIEW + """SELECT user_id, concat_ws('; ', CASE WHEN exclude_from_ml IS NULL THEN 'exclude_from_ml: true or false expected' END,
      CASE WHEN event_type NOT IN ('censor', 'event') THEN 'event_type: one of censor, event or null expected' END, CASE WHEN reason IS NULL THEN 'reason: text expected' END,
      CASE WHEN validated_at IS NULL THEN 'validated_at: text expected' END, CASE WHEN NOT exclude_from_ml AND event_type IS NULL THEN 'a kept entity needs an event_type' END,
      CASE WHEN NOT exclude_from_ml AND event_type = 'event' AND last_available_cycle IS NULL THEN 'an event needs a last_available_cycle' END) AS errors FROM dec""",
)
def decision_rule_errors(t):
    dec, _, _ = review_inputs(t)
    return audit.decision_errors(dec).select("user_id", F.array_join("errors", "; ").alias("errors"))


# Decision entries as JSON text, with every kind of fault the checks know.
ENTRY_PARTS = (
    ("exclude_from_ml", "CASE WHEN k % 11 = 3 THEN '\"no\"' WHEN k % 11 = 5 THEN '1' WHEN k % 4 = 0 THEN 'true' ELSE 'false' END"),
    ("last_available_cycle", "CASE WHEN k % 9 = 2 THEN '7.5' WHEN k % 9 = 4 THEN 'null' WHEN k % 9 = 6 THEN '\"7\"' ELSE cast(k AS VARCHAR(9)) END"),
    ("event_type", "CASE WHEN k % 5 = 0 THEN 'null' WHEN k % 5 = 1 THEN '\"censor\"' WHEN k % 13 = 2 THEN '3' WHEN k % 13 = 4 THEN '\"pause\"' ELSE '\"event\"' END"),
    ("reason", "CASE WHEN k % 10 = 9 THEN '[\"a\", 1]' ELSE concat('\"', event_type, '\"') END"),
    ("validated_at", "CASE WHEN k % 8 = 5 THEN '{\"day\": 20240101}' ELSE '\"2024-01-01\"' END"),
)
ENTRY_TEXT = (
    "CASE WHEN k = 96 THEN '[1, 2]' WHEN k = 97 THEN '\"text\"' WHEN k = 98 THEN '12' ELSE concat('{'"
    + "".join(f""", '"{name}": ', {value}, ', '""" for name, value in ENTRY_PARTS)
    + """, CASE WHEN k % 6 = 1 THEN '"note": 1, ' WHEN k % 6 = 3 THEN '"b": 1, "a": 2, ' ELSE '' END, CASE WHEN k % 7 = 2 THEN '"extra": true}' ELSE '"n_regular_at_review": 5}' END) END"""
)
KIND_SQL = "CASE json_type(j, '$.{0}') WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' ELSE 'null' END"
KINDS = {f: KIND_SQL.format(f) for f in ("exclude_from_ml", "last_available_cycle", "event_type", "reason", "validated_at", "n_regular_at_review")}


@query(
    "decision_type_errors",
    f"""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    j AS (SELECT event_id, CAST({ENTRY_TEXT} AS JSON) AS j FROM e),
    t AS (SELECT event_id, j, json_type(j) AS whole, coalesce(json_keys(j), []) AS ks, {", ".join(f"{v} AS k_{f}" for f, v in KINDS.items())}, j ->> '$.event_type' AS et, j ->> '$.exclude_from_ml' AS ex FROM j),
    r AS (SELECT *, [f FOR f IN {list(KINDS)} IF NOT list_contains(ks, f)] AS gone, [f FOR f IN ks IF NOT list_contains({list(KINDS)}, f)] AS more FROM t)
    SELECT event_id, CASE whole WHEN 'OBJECT' THEN concat_ws('; ',
      CASE WHEN len(gone) > 0 THEN 'missing fields: ' || array_to_string(list_sort(gone), ', ') END,
      CASE WHEN len(more) > 0 THEN 'unknown fields: ' || array_to_string(list_sort(more), ', ') END,
      CASE WHEN k_exclude_from_ml <> 'bool' THEN 'exclude_from_ml: bool expected, found ' || k_exclude_from_ml END,
      CASE WHEN k_last_available_cycle NOT IN ('int', 'bool', 'null') THEN 'last_available_cycle: int expected, found ' || k_last_available_cycle END,
      CASE WHEN k_event_type <> 'null' AND (k_event_type <> 'str' OR et NOT IN ('censor', 'event')) THEN 'event_type: one of censor, event or null expected' END,
      CASE WHEN k_reason NOT IN ('str', 'null') THEN 'reason: str expected, found ' || k_reason END,
      CASE WHEN k_validated_at NOT IN ('str', 'null') THEN 'validated_at: str expected, found ' || k_validated_at END,
      CASE WHEN k_n_regular_at_review NOT IN ('int', 'bool', 'null') THEN 'n_regular_at_review: int expected, found ' || k_n_regular_at_review END,
      CASE WHEN k_exclude_from_ml = 'bool' AND ex = 'false' AND k_event_type = 'null' THEN 'a kept entity needs an event_type' END,
      CASE WHEN k_exclude_from_ml = 'bool' AND ex = 'false' AND k_event_type = 'str' AND et = 'event' AND k_last_available_cycle = 'null' THEN 'an event needs a last_available_cycle' END)
      WHEN 'ARRAY' THEN 'object expected, found list' WHEN 'VARCHAR' THEN 'object expected, found str' ELSE 'object expected, found int' END AS errors FROM r""",
)
def decision_type_errors(t):
    rows = t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    entries = rows.select("event_id", F.expr(ENTRY_TEXT).alias("entry"))
    return audit.decision_text_errors(entries, "entry").select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "attached_ordinal",
    """WITH reg AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal FROM orders WHERE o_orderstatus = 'F'),
    rec AS (SELECT l_orderkey AS o_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1)
    SELECT o_orderkey, quantity, ordinal FROM rec LEFT JOIN reg USING (o_orderkey)""",
)
def attached_ordinal(t):
    registry = series.number_cycles(
        t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], bound=t.rows("orders")
    ).rows()
    recomputed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("quantity"))
    return audit.attach_ordinal(recomputed, registry.withColumnRenamed("cycle", "ordinal"), ["o_orderkey"], "ordinal")


@query("stale_decisions", "WITH " + REVIEW + "SELECT user_id, stale_reason FROM stale")
def stale_decisions(t):
    dec, cur, _ = review_inputs(t)
    return audit.stale_decisions(dec, cur, "user_id", "recorded", "n_full")


@query("tail_outliers", "WITH " + REVIEW + "SELECT user_id, n_tail, tail_cycles FROM tail")
def tail_outliers(t):
    _, cur, outliers = review_inputs(t)
    return audit.tail_outliers(outliers, cur, "user_id", "cycle", "n_full")


def flagged_users(t):
    """Users whose automatic fade comes late: stands for the sustained-step flag."""
    from lifecurve.operators.ordered import arrange

    cells, meas, decisions, outliers = cell_inputs(t)
    rows = meas.join(outliers, ["user_id", "cycle"], "left_anti").join(
        decisions.select("user_id", "last_available_cycle"), "user_id", "left"
    )
    o = arrange(rows, ["user_id"], ["cycle"], bound=t.rows("events"))
    base = meas.where("cycle = 1").select("user_id", F.col("dis").alias("base"))
    o = o.join_facts(base).where("base > 0 and (last_available_cycle is null or cycle <= last_available_cycle)")
    fade = series.sticky_fade(o.add(retention=F.col("dis") / F.col("base")), "user_id")
    return fade.where("last_fade >= 60").select("user_id")


@query(
    "review_queue",
    "WITH " + REVIEW + """, ids AS (SELECT user_id FROM flag UNION SELECT user_id FROM tail), pend AS (SELECT user_id FROM ids WHERE user_id NOT IN (SELECT user_id FROM dec) UNION SELECT user_id FROM stale)
    SELECT p.user_id, concat_ws(',', s.stale_reason, CASE WHEN f.user_id IS NOT NULL THEN 'sustained_step' END, CASE WHEN t.user_id IS NOT NULL THEN 'tail_outlier' END) AS review_reason,
     s.user_id IS NULL AS needs_template FROM pend p LEFT JOIN stale s USING (user_id) LEFT JOIN flag f USING (user_id) LEFT JOIN tail t USING (user_id)""",
)
def review_queue(t):
    dec, cur, outliers = review_inputs(t)
    tail = audit.tail_outliers(outliers, cur, "user_id", "cycle", "n_full")
    stale = audit.stale_decisions(dec, cur, "user_id", "recorded", "n_full")
    return audit.review_queue(flagged_users(t), tail, stale, dec, "user_id")


@query(
    "informational_decisions",
    "WITH " + REVIEW + "SELECT user_id FROM dec WHERE user_id NOT IN (SELECT user_id FROM flag) AND user_id NOT IN (SELECT user_id FROM tail) AND user_id NOT IN (SELECT user_id FROM stale)",
)
def informational_decisions(t):
    dec, cur, outliers = review_inputs(t)
    tail = audit.tail_outliers(outliers, cur, "user_id", "cycle", "n_full").select("user_id")
    stale = audit.stale_decisions(dec, cur, "user_id", "recorded", "n_full")
    return audit.informational(dec, flagged_users(t).unionByName(tail), stale, "user_id")


@query("fill_review_counts", "WITH " + REVIEW + "SELECT user_id, coalesce(recorded, n_full) AS recorded FROM dec LEFT JOIN cur USING (user_id)")
def fill_review_counts(t):
    dec, cur, _ = review_inputs(t)
    return audit.fill_review_counts(dec.select("user_id", "recorded"), cur, "user_id", "recorded", "n_full")


WITNESS = ", ".join(f"arg_min(value, cycle) FILTER (WHERE cycle >= {n}) AS w{n}" for n in HORIZONS)


@query(
    "disagreements",
    "WITH " + LABELS + ", lb AS (SELECT *, " + LABEL_HORIZONS + " FROM lab), wit AS (SELECT user_id, " + WITNESS + """ FROM cyc GROUP BY 1),
    th AS (SELECT user_id, CASE WHEN avg(k) >= 50 THEN 'good' ELSE 'bad' END AS verdict FROM cyc GROUP BY 1)
    """
    + " UNION ALL ".join(
        f"""SELECT user_id, verdict, {n} AS horizon, label_n{n} AS label, w{n} AS value_at FROM lb JOIN wit USING (user_id) JOIN th USING (user_id)
        WHERE NOT ((verdict = 'good' AND label_n{n} = 'pass') OR (verdict = 'bad' AND label_n{n} = 'bad'))"""
        for n in HORIZONS
    ),
)
def disagreements(t):
    c = cycles(t, "k").rows()
    verdict = c.groupBy("user_id").agg(F.when(F.avg("k") >= 50, "good").otherwise("bad").alias("verdict"))
    witness = series.asof_forward(c, "user_id", "cycle", "value", HORIZONS)
    wide = label_rows(t).join(witness, "user_id").join(verdict, "user_id")
    keep = ["user_id", "verdict", *[f"label_n{n}" for n in HORIZONS], *[f"value_at_n{n}" for n in HORIZONS]]
    return audit.disagreements(
        wide.select(*keep),
        "verdict",
        {n: f"label_n{n}" for n in HORIZONS},
        {"good": "pass", "bad": "bad"},
        ["value_at_n{n}"],
    )


@query(
    "lifetime_consistency",
    "WITH " + LABELS + """, j AS (SELECT lab.user_id, n_regular, last_fade_cycle, f.n_full, fd.lf FROM lab JOIN facts f USING (user_id) LEFT JOIN fd USING (user_id))
    SELECT 'lifetime' AS pair, count(*) FILTER (WHERE n_regular IS NOT NULL AND n_full IS NOT NULL) AS n_both, count(*) FILTER (WHERE n_regular = n_full) AS n_equal,
      count(*) FILTER (WHERE n_regular IS NOT NULL AND n_full IS NULL) AS n_left_only, count(*) FILTER (WHERE n_regular IS NULL AND n_full IS NOT NULL) AS n_right_only,
      round(avg(abs(n_regular - n_full)), 6) AS mean_abs_gap FROM j""",
)
def lifetime_consistency(t):
    _, meas, _, _ = cell_inputs(t)
    full = meas.groupBy("user_id").agg(F.max("cycle").alias("n_full"))
    df = label_rows(t).join(full, "user_id")
    out = audit.lifetime_consistency(df, {"lifetime": ("n_regular", "n_full")})
    return out.withColumn("mean_abs_gap", F.round("mean_abs_gap", 6))


@query(
    "audit_sample",
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n FROM c WHERE n >= 60 ORDER BY md5('7/' || user_id), user_id LIMIT 20",
)
def audit_sample(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return audit.audit_sample(counts, "user_id", F.col("n") >= 60, 20, 7)


@query(
    "strongest_class",
    """WITH r AS (SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) AS m FROM orders GROUP BY 1),
    j AS (SELECT DISTINCT r.o_custkey, CASE m WHEN 3 THEN 'urgent' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS strongest FROM r) SELECT strongest, count(*) AS n FROM j GROUP BY 1""",
)
def strongest_class(t):
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")
        .when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .otherwise("none")
    )
    per = rollup.strongest_class(
        t.orders.withColumn("kind", kind), "o_custkey", "kind", {"urgent": 3, "high": 2, "medium": 1, "none": 0}
    )
    return per.groupBy("strongest").agg(F.count(F.lit(1)).alias("n"))


@query("registry_rows", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def registry_rows(t):
    return readers.read_registry(t.events, "purchase", ["event_id", "user_id", "value"], "event_type")


@query("decision_map", "SELECT event_id, u.key AS name, CAST(json_extract_string(props, '$.' || u.key) AS INT) AS number FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) u")
def decision_map(t):
    return t.events.select("event_id", readers.explode_json_map(F.col("props"), T.IntegerType()).alias("name", "number"))


@query("find_runs", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def find_runs(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return readers.find_runs(df, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).drop("o_custkey")


@query(
    "snapshot_choice",
    """SELECT snapshot, n_files FROM (SELECT strftime(ts, '%Y-%m-%d %H') AS snapshot, count(DISTINCT event_type) AS n_files FROM events WHERE event_type IN ('error', 'view', 'click') GROUP BY 1)
    WHERE n_files = 3 ORDER BY snapshot DESC LIMIT 1""",
)
def snapshot_choice(t):
    files = t.events.select(F.date_format("ts", "yyyy-MM-dd HH").alias("snapshot"), F.col("event_type").alias("file"))
    return readers.snapshot_choice(files, ["error", "view", "click"], latest="2024-02-30 00")


@query(
    "path_axes",
    """SELECT page_id, nullif(regexp_extract(replace(replace(url, '?', '/'), '&', '/'), '(?:^|/)page=([^/]+)', 1), '') AS page,
     nullif(regexp_extract(replace(replace(url, '?', '/'), '&', '/'), '(?:^|/)ref=([^/]+)', 1), '') AS ref FROM pages""",
)
def path_axes(t):
    path = F.translate("url", "?&", "//")
    return t.pages.select(
        "page_id", readers.path_part(path, "page").alias("page"), readers.path_part(path, "ref").alias("ref")
    )


@query(
    "scalar_functions",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t, CASE WHEN l_tax > 0.07 THEN 'NaN'::DOUBLE ELSE l_tax END AS tn FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(d * 10) >= 0.5 THEN q / (d * 10) END, 6) AS ratio, round(CASE WHEN d <> 0 THEN ln(abs(d)) END, 6) AS log_abs,
     round(CASE WHEN NOT isnan(tn) THEN d - tn END, 6) AS shift, round(CASE WHEN NOT isnan(tn) THEN abs(tn - d) END, 6) AS gap, coalesce(CASE WHEN NOT isnan(tn) THEN tn END, d) AS pick,
     CASE WHEN isnan(tn) THEN false ELSE tn = d END AS same, least(greatest(q, 5), 40) AS clipped,
     CASE WHEN t * 100 > d * 100 THEN CASE WHEN t * 100 > q THEN 'tax' ELSE 'quantity' END ELSE CASE WHEN d * 100 > q THEN 'discount' ELSE 'quantity' END END AS top,
     round((power(q, 0.5) - 1) / 0.5, 6) AS boxcox, round(sqrt(q), 6) AS root FROM x""",
)
def scalar_functions(t):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    tn = F.when(x > 0.07, F.lit(float("nan"))).otherwise(x)
    items = F.array(
        F.struct(F.lit("quantity").alias("name"), q.alias("size")),
        F.struct(F.lit("discount").alias("name"), (d * 100).alias("size")),
        F.struct(F.lit("tax").alias("name"), (x * 100).alias("size")),
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        r6(scalars.safe_ratio(q, d * 10), "ratio"),
        r6(scalars.safe_log_abs(d), "log_abs"),
        r6(scalars.signed_shift(tn, d), "shift"),
        r6(scalars.abs_diff(tn, d), "gap"),
        scalars.first_present(tn, d).alias("pick"),
        scalars.same_value(tn, d).alias("same"),
        scalars.clip(q, 5.0, 40.0).alias("clipped"),
        scalars.dominant(items, "size", "name").alias("top"),
        r6(scalars.transform_target(q, "boxcox", 0.5), "boxcox"),
        r6(scalars.transform_target(q, "sqrt"), "root"),
    )


@query(
    "boundary_text",
    """WITH a AS (SELECT l_orderkey, l_linenumber, [CAST(l_quantity AS BIGINT), CAST(l_quantity + l_linenumber AS BIGINT)] AS b, l_linenumber AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN CAST(b[1] AS VARCHAR) ELSE b[1] || ',' || b[2] END AS boundaries FROM a""",
)
def boundary_text(t):
    lengths = F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.lit(1).cast("long"))
    regimes = F.slice(lengths, 1, F.least(F.col("l_linenumber"), F.lit(3)))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", scalars.joined_list(series.boundaries_of(regimes)).alias("boundaries")
    )
