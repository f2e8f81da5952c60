"""Queries on splits and learned models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lifecurve.operators import learn, metrics, rollup, search, survival
from lifecurve.operators.ordered import SPREAD_ROWS, spread_evenly, with_single
from lifecurve.operators.ranks import roc_auc
from lifecurve.queries.common import CYC, cycles, r6
from lifecurve.queries.label_stack import STATUS, fade_status
from lifecurve.queries.registry import query
from lifecurve.session import materialize
from lifecurve.sources.readers import path_part

HELD = "h AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42/' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels)"


@query("strat_holdout", f"WITH {HELD} SELECT doc_id, quality, CASE WHEN rk <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM h")
def strat_holdout(t):
    return learn.stratified_holdout(t.labels.select("doc_id", "quality"), "quality", "doc_id", bound=t.rows("labels"))


@query("kfold_assign", f"WITH {HELD} SELECT doc_id, quality, CAST((rk - 1) % 5 AS INT) AS fold FROM h")
def kfold_assign(t):
    return learn.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id", bound=t.rows("labels"))


@query(
    "production_split",
    "SELECT 'train' AS part, count(*) AS n FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'score', count(*) FROM documents",
)
def production_split(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    train, score = learn.production_split(df, F.col("quality").isNotNull())
    parts = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for p, n in ((train, "train"), (score, "score"))]
    return parts[0].unionByName(parts[1])


DIMS = 64


def vectors(t):
    """Embeddings with a two-class target, as a vector and as columns."""
    return t.embeddings.select(
        "vec_id",
        (F.col("label") >= 5).cast("int").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        *[F.get(F.col("embedding"), i).cast("double").alias(f"f{i}") for i in range(DIMS)],
    )


COLUMNS = [f"f{i}" for i in range(DIMS)]


def with_gaps(df):
    """Small values count as not measured."""
    return df.withColumns({c: F.when(F.abs(c) > 0.02, F.col(c)) for c in COLUMNS})


@query("filled_constant", "SELECT vec_id, " + ", ".join(f"CASE WHEN abs(embedding[{i + 1}]::DOUBLE) > 0.02 THEN embedding[{i + 1}]::DOUBLE ELSE 0.0::DOUBLE END AS f{i}" for i in range(DIMS)) + " FROM embeddings")
def filled_constant(t):
    return learn.fill_constant(with_gaps(vectors(t)), COLUMNS).select("vec_id", *COLUMNS)


FILLS = ("median", "mean", "mode", "constant")


@query(
    "imputed_columns",
    """WITH g AS (SELECT vec_id, row_number() OVER (PARTITION BY label >= 5 ORDER BY md5('42/' || vec_id), vec_id) <= ceil(count(*) OVER (PARTITION BY label >= 5) * 0.2::DOUBLE) AS held,
      list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) > 0.02 THEN x::DOUBLE END) AS v FROM embeddings),
    l AS (SELECT held, 'f' || (i - 1) AS feature, v[i] AS value FROM g, (SELECT unnest(range(1, 65)) AS i)),
    c AS (SELECT feature, value, count(*) AS n FROM l WHERE NOT held AND value IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT feature, value FROM c QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1),
    t AS (SELECT feature, quantile_cont(value, 0.5) AS median, avg(value) AS mean FROM l WHERE NOT held GROUP BY 1),
    f AS (SELECT 'median' AS strategy, feature, median AS fill FROM t UNION ALL SELECT 'mean', feature, mean FROM t UNION ALL SELECT 'mode', feature, value FROM m UNION ALL SELECT 'constant', feature, 0.0 FROM t)
    SELECT strategy, feature, round(fill, 9) AS fill, count(*) FILTER (WHERE NOT held AND value IS NULL) AS n_train, count(*) FILTER (WHERE held AND value IS NULL) AS n_held,
      round(sum(coalesce(value, fill)) FILTER (WHERE held), 6) AS held_sum FROM f JOIN l USING (feature) GROUP BY 1, 2, fill""",
)
def imputed_columns(t):
    """Fills of every strategy from the train part alone, and what they do to the part held out."""
    bound = t.rows("embeddings")
    df = learn.stratified_holdout(with_gaps(vectors(t)).drop("features"), "y", "vec_id", bound=bound)
    df = df.withColumn("held", F.col("split") == "test").select("vec_id", "held", *COLUMNS)
    out = None
    for strategy in FILLS:
        fills = learn.fill_values(df.where("not held"), COLUMNS, strategy, bound=bound)
        long = df.unpivot(["vec_id", "held"], COLUMNS, "feature", "value")
        whole = learn.filled_with(df, fills, COLUMNS).unpivot(["vec_id", "held"], COLUMNS, "feature", "whole")
        gaps = long.groupBy("feature").agg(F.count_if(~F.col("held") & F.col("value").isNull()).alias("n_train"), F.count_if(F.col("held") & F.col("value").isNull()).alias("n_held"))
        sums = whole.where("held").groupBy("feature").agg(F.round(F.sum("whole"), 6).alias("held_sum"))
        part = fills.join(gaps, "feature").join(sums, "feature")
        part = part.select(F.lit(strategy).alias("strategy"), "feature", F.round("fill", 9).alias("fill"), "n_train", "n_held", "held_sum")
        out = part if out is None else out.unionByName(part)
    return out


@query("rf_scores")
def rf_scores(t):
    df = learn.balanced_weights(vectors(t), "y")
    model = learn.forest_classifier("y", weight="weight").fit(df)
    return learn.positive_probability(model.transform(df)).select("vec_id", "y", F.round("proba", 6).alias("proba"))


@query("gbt_scores")
def gbt_scores(t):
    df = with_gaps(vectors(t)).drop("features")
    model = learn.model_pipeline(COLUMNS, learn.boosted_classifier("y")).fit(df)
    return learn.positive_probability(model.transform(df)).select("vec_id", "y", F.round("proba", 6).alias("proba"))


def life_rows(t):
    feats = cycles(t, "k").rows().groupBy("user_id").agg(
        F.avg("k").alias("mean_k"), F.log(F.max("value")).alias("log_top"), F.log(F.avg("value")).alias("log_mean")
    )
    event = F.col("status") == "faded"
    truth = fade_status(t).select(
        "user_id",
        event.cast("double").alias("event"),
        F.when(event, F.col("last_fade_cycle")).otherwise(F.col("n_regular")).cast("double").alias("time"),
    )
    return feats.join(truth, "user_id")


@query("aft_median")
def aft_median(t):
    df = life_rows(t)
    model = learn.model_pipeline(["mean_k", "log_top", "log_mean"], learn.life_model("time", "event", maxIter=30)).fit(df)
    return learn.median_life(model.transform(df)).select("user_id", "time", "event", F.round("median_time", 4).alias("median_time"))


@query("gbt_life")
def gbt_life(t):
    df = life_rows(t).where("event = 1")
    model = learn.model_pipeline(["mean_k", "log_top", "log_mean"], learn.boosted_regressor("time"), None).fit(df)
    return model.transform(df).select("user_id", "time", F.round("prediction", 4).alias("predicted"))


SEEDS = (1, 2)


def nested(t):
    """5 x 5 folds over the whole grid for every seed; the embedding is the array of features."""
    df = t.embeddings.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), "embedding")
    return search.nested_search(df, "vec_id", "y", "embedding", seeds=SEEDS, bound=t.rows("embeddings"))


@query("nested_search")
def nested_search(t):
    """The parameters that the inner folds choose on every outer-train slice."""
    chosen = nested(t).chosen
    return chosen.select(F.col("seed").cast("int").alias("seed"), "outer_fold", "rate", "penalty", r6(F.col("inner_score"), "inner_score"))


@query(
    "nested_coverage",
    "SELECT s AS seed, count(*) AS n_rows, count(*) AS n_entities, true AS once FROM embeddings, (VALUES (1), (2)) v(s) GROUP BY 1",
)
def nested_coverage(t):
    return learn.coverage(nested(t).scores.withColumn("seed", F.col("seed").cast("int")), "seed", "vec_id")


@query("oof_scores")
def oof_scores(t):
    wide = rollup.ensemble(nested(t).scores, "vec_id", "proba").select("vec_id", F.round("proba_mean", 6).alias("proba_mean"), "n_seeds")
    return learn.on_spine(t.embeddings.select("vec_id"), wide, "vec_id", ["proba_mean", "n_seeds"])


@query(
    "fitted_score_checks",
    """SELECT model, count(*) AS n, count(*) AS n_scored, CAST(0 AS BIGINT) AS n_outside, true AS above_chance
       FROM embeddings, (VALUES ('forest'), ('boosted'), ('out_of_fold')) v(model) GROUP BY 1
       UNION ALL SELECT 'median_life', count(DISTINCT user_id), count(DISTINCT user_id), 0, true FROM events""",
)
def fitted_score_checks(t):
    """What holds for scores of any right fit: one per entity, in range, better than chance on rows learnt from.

    Out of fold (every entity scored by models that did not see it) only range and coverage are asked for.
    """
    bound = t.rows("embeddings")
    truth = t.embeddings.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"))
    fold = oof_scores(t).select("vec_id", F.col("proba_mean").alias("proba")).join(truth, "vec_id")
    parts = []
    for name, scored in (("forest", rf_scores(t)), ("boosted", gbt_scores(t)), ("out_of_fold", fold)):
        auc = roc_auc(scored, [], "y", "proba", bound=bound)
        better = (F.col("auc") > 0.5) | F.lit(name == "out_of_fold")
        parts.append((name, "vec_id", "proba", 0.0, 1.0, scored, auc.select(better.alias("above_chance"))))
    life = aft_median(t)
    # Longer predictions go with longer lives.
    along = life.agg((F.corr("median_time", "time") > 0).alias("above_chance"))
    parts.append(("median_life", "user_id", "median_time", 1.0, 5000.0, life, along))
    out = None
    for name, entity, score, low, high, scored, better in parts:
        counts = scored.groupBy(entity).agg(F.count(score).alias("k"), F.max((~F.col(score).between(low, high)).cast("int")).alias("bad"))
        facts = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 1).alias("n_scored"), F.count_if(F.col("bad") == 1).alias("n_outside"))
        part = with_single(facts, better).select(F.lit(name).alias("model"), "n", "n_scored", "n_outside", "above_chance")
        out = part if out is None else out.unionByName(part)
    return out


@query("param_search")
def param_search(t):
    bound = t.rows("embeddings")
    folded = learn.stratified_folds(vectors(t).select("vec_id", "y", "features"), "y", "vec_id", folds=5, bound=bound)
    # The folds are numbered per class, which leaves two tasks with rows; all 30 fits read them. A forest draws its rows
    # per partition, so a table that is worth one task keeps the partitions it has.
    if bound > SPREAD_ROWS:
        folded = materialize(spread_evenly(folded, bound, "vec_id"))
    est = learn.forest_classifier("y")
    space = {est.maxDepth: [2, 4, 6], est.minInstancesPerNode: [1, 5]}
    found = learn.search(folded, est, space, fold="fold", folds=5, draws=6, label="y", parallelism=8)
    scored = learn.positive_probability(found.bestModel.transform(vectors(t)))
    return scored.select("vec_id", F.round("proba", 6).alias("proba"))


@query("perm_importance")
def perm_importance(t):
    df = vectors(t).drop("features")
    model = learn.model_pipeline(COLUMNS, learn.forest_classifier("y"), None).fit(df)
    permuted = learn.permutation_importance(df, model, "vec_id", "y", COLUMNS, bound=t.rows("embeddings"))
    out = learn.importance_table(model, COLUMNS, permuted)
    return out.select("feature", *[r6(F.col(c), c) for c in ("native", "importance_mean", "importance_std")])


@query(
    "train_test_gap",
    f"""WITH {HELD}, s AS (SELECT h.doc_id, quality AS y, CAST(n_chars >= 1500 AS INT) AS yhat, CASE WHEN rk <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM h JOIN documents USING (doc_id)),
    m AS (SELECT split, avg(CAST(y = yhat AS DOUBLE)) AS accuracy, count(*) FILTER (WHERE y = 1 AND yhat = 1) / count(*) FILTER (WHERE y = 1) AS recall FROM s GROUP BY 1)
    SELECT round(max(accuracy) FILTER (WHERE split = 'train'), 6) AS train_accuracy, round(max(accuracy) FILTER (WHERE split = 'test'), 6) AS test_accuracy,
      round(max(recall) FILTER (WHERE split = 'train'), 6) AS train_recall, round(max(recall) FILTER (WHERE split = 'test'), 6) AS test_recall,
      round(max(accuracy) FILTER (WHERE split = 'train') - max(accuracy) FILTER (WHERE split = 'test'), 6) AS gap_accuracy,
      round(max(recall) FILTER (WHERE split = 'train') - max(recall) FILTER (WHERE split = 'test'), 6) AS gap_recall FROM m""",
)
def train_test_gap(t):
    held = learn.stratified_holdout(t.labels.select("doc_id", "quality"), "quality", "doc_id", bound=t.rows("labels"))
    df = held.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "split", F.col("quality").alias("y"), (F.col("n_chars") >= 1500).cast("int").alias("yhat"), "n_chars"
    )
    m = metrics.classification_metrics(df, ["split"], "y", "yhat", "n_chars", "split", bound=t.rows("labels")).where("scope = 'all'")
    out = metrics.train_test_gap(m, [], "split", ["accuracy", "recall"])
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query(
    "boxcox_lambda",
    """WITH y AS (SELECT l_returnflag AS flag, l_quantity AS y FROM lineitem WHERE l_quantity > 0), g AS (SELECT round(-2 + i * 0.1::DOUBLE, 12) AS l FROM range(41) t(i)),
    m AS (SELECT flag, l, count(*) AS n, var_pop(CASE WHEN abs(l) < 1e-12 THEN ln(y) ELSE (power(y, l) - 1) / l END) AS v, sum(ln(y)) AS s FROM y, g GROUP BY 1, 2),
    b0 AS (SELECT flag, arg_max(l, -n / 2 * ln(v) + (l - 1) * s) AS best FROM m GROUP BY 1),
    m1 AS (SELECT flag, l, count(*) AS n, var_pop(CASE WHEN abs(l) < 1e-12 THEN ln(y) ELSE (power(y, l) - 1) / l END) AS v, sum(ln(y)) AS s
      FROM (SELECT y.flag, y, round(best + i * 0.01::DOUBLE, 12) AS l FROM y JOIN b0 USING (flag), range(-10, 11) t(i)) GROUP BY 1, 2),
    b1 AS (SELECT flag, arg_max(l, -n / 2 * ln(v) + (l - 1) * s) AS best FROM m1 GROUP BY 1),
    m2 AS (SELECT flag, l, count(*) AS n, var_pop(CASE WHEN abs(l) < 1e-12 THEN ln(y) ELSE (power(y, l) - 1) / l END) AS v, sum(ln(y)) AS s
      FROM (SELECT y.flag, y, round(best + i * 0.001::DOUBLE, 12) AS l FROM y JOIN b1 USING (flag), range(-10, 11) t(i)) GROUP BY 1, 2)
    SELECT flag, arg_max(l, -n / 2 * ln(v) + (l - 1) * s) AS lambda FROM m2 GROUP BY 1""",
)
def boxcox_lambda(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return learn.boxcox_lambda(df, ["flag"], "l_quantity")


@query(
    "sweep_rollup",
    """WITH r AS (SELECT 'runs/model=' || event_type || '/N=' || (k // 25) AS path, day(ts) AS seed, CASE WHEN value > 100 THEN 0 ELSE -1 END AS fold, value FROM
      (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
    SELECT regexp_extract(path, 'model=([^/]+)', 1) AS model, regexp_extract(path, 'N=([^/]+)', 1) AS level, round(avg(value), 6) AS mean, count(*) AS n FROM r WHERE fold = -1 GROUP BY 1, 2""",
)
def sweep_rollup(t):
    k = F.get_json_object("props", "$.k").cast("long")
    runs = t.events.select(
        F.concat(F.lit("runs/model="), F.col("event_type"), F.lit("/N="), F.floor(k / 25).cast("string")).alias("path"),
        F.when(F.col("value") > 100, 0).otherwise(-1).alias("fold"),
        "value",
    )
    whole = learn.stack_runs(runs).select(
        path_part(F.col("path"), "model").alias("model"), path_part(F.col("path"), "N").alias("level"), "value"
    )
    out = rollup.across_seeds(whole, ["model", "level"])
    return out.select("model", "level", r6(F.col("mean"), "mean"), "n")
