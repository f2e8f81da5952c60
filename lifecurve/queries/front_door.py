"""Queries through files: documents, samples, run folders, mirrors and snapshots, written and read back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lifecurve.operators import learn, rollup
from lifecurve.plans import build
from lifecurve.queries.common import HORIZONS, cycles
from lifecurve.queries.label_stack import LABEL_HORIZONS, LABELS, inputs_of
from lifecurve.queries.learning import COLUMNS, vectors
from lifecurve.queries.registry import query
from lifecurve.session import new_path
from lifecurve.sources import readers, writers

#: A cell is a stretch of a user's events, so one document holds no more than this many.
CELL_EVENTS = 1000

# SQL twin of ``cell_rows``: the events with the cell in the place of the user.
CELL_SQL = f"""WITH ev AS (SELECT * REPLACE (user_id || '-' || ((rn - 1) // {CELL_EVENTS}) AS user_id)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),"""
CELL_LABELS = CELL_SQL + LABELS.replace("FROM events", "FROM ev")


def cell_rows(t):
    at = F.col("cycle") - 1
    return cycles(t, "event_type", "k").rows().select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(at / CELL_EVENTS).cast("string")).alias("cell_name"),
        (at % CELL_EVENTS + 1).alias("cycle"),
        "event_type",
        "value",
        "k",
    )


def write_documents(t, rows, *, broken: bool = False) -> str:
    """One JSON document per cell and line; ``broken`` cuts those whose number of events divides by seven."""
    cells, meas, _, _ = inputs_of(rows, "cell_name")
    event = F.struct(
        F.lit("regular_cd").alias("event_kind"),
        F.col("cycle").cast("int").alias("regular_cycle"),
        F.col("cycle").cast("int").alias("cd_index"),
        F.col("dis").alias("capacity_discharge_ah"),
        F.col("chg").alias("capacity_charge_ah"),
        F.col("ce").alias("coulombic_efficiency"),
    )
    nested = meas.groupBy("cell_name").agg(F.collect_list(event).alias("cd_events"))
    regimes = F.array(F.struct(F.col("first_regime_n").cast("int").alias("n_regular_cd"), F.lit(1.0).alias("baseline_i_a")))
    docs = cells.join(nested, "cell_name").withColumn("regular_rate_regimes", regimes).drop("first_regime_n")
    text = F.to_json(F.struct(*docs.columns))
    if broken:
        text = F.when(F.size("cd_events") % 7 == 0, F.substring(text, 1, 60)).otherwise(text)
    path = new_path(t.spark, "documents")
    docs.select(text.alias("value")).write.text(path)
    return path


@query(
    "document_cycles",
    CELL_SQL
    + """c AS (SELECT user_id AS cell_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS regular_cycle, value AS capacity_discharge_ah,
      count(*) OVER (PARTITION BY user_id) AS n FROM ev)
    SELECT cell_name, CAST(regular_cycle AS INT) AS regular_cycle, capacity_discharge_ah FROM c WHERE n % 7 <> 0""",
)
def document_cycles(t):
    good, _ = readers.read_documents(t.spark, write_documents(t, cell_rows(t), broken=True), lines=True)
    return readers.flatten_cycles(good).select("cell_name", "regular_cycle", "capacity_discharge_ah")


@query(
    "document_rejects",
    CELL_SQL + "c AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id AS cell_name, 60 AS n_left FROM c WHERE n % 7 = 0",
)
def document_rejects(t):
    _, bad = readers.read_documents(t.spark, write_documents(t, cell_rows(t), broken=True), lines=True)
    name = F.regexp_extract(readers.CORRUPT, '"cell_name":"([^"]+)"', 1)
    return bad.select(name.alias("cell_name"), F.length(readers.CORRUPT).alias("n_left"))


@query("document_labels", CELL_LABELS + f"SELECT user_id AS cell_name, * EXCLUDE (user_id), {LABEL_HORIZONS} FROM lab")
def document_labels(t):
    rows = cell_rows(t)
    _, _, decisions, outliers = inputs_of(rows, "cell_name")
    decided, marked = new_path(t.spark, "decisions"), new_path(t.spark, "outliers")
    decisions.write.json(decided)
    mark = F.struct("cycle", F.lit(9.0).alias("z_score"))
    outliers.groupBy("cell_name").agg(F.count(F.lit(1)).alias("n_outliers"), F.collect_list(mark).alias("outliers")).write.json(marked)
    out = build.label_table(t.spark, write_documents(t, rows), decided, marked, horizons=HORIZONS, lines=True)
    return out.withColumn("final_retention", F.round("final_retention", 6))


@query(
    "samples_of_entities",
    "SELECT user_id, ts, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)",
)
def samples_of_entities(t):
    """Through the skipping index: only files that hold a wanted entity are opened."""
    path = new_path(t.spark, "samples")
    writers.write_samples(t.events, path, "user_id", ["ts", "event_id"])
    wanted = t.events.where("event_type = 'error' and value > 200").select("user_id")
    return readers.read_indexed_samples(t.spark, path, ["user_id", "ts", "value"], wanted, "user_id", schema=t.events.schema)


@query(
    "run_summaries",
    "SELECT event_type AS model, CAST(day(ts) AS INT) AS n, 'run=' || event_type || '-' || day(ts) AS run_dir, count(*) AS n_rows, round(avg(value), 6) AS score FROM events GROUP BY event_type, day(ts)",
)
def run_summaries(t):
    """One folder per run; a run's summary takes model and n from its manifest."""
    path = new_path(t.spark, "runs")
    runs = t.events.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("n")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("score")
    ).withColumn("run", F.concat_ws("-", "model", "n"))
    runs = runs.repartition("run")
    runs.select("run", "model", "n").write.partitionBy("run").json(f"{path}/manifests")
    runs.select("run", "n_rows", "score").write.partitionBy("run").json(f"{path}/summaries")
    manifests = readers.read_manifests(t.spark, f"{path}/manifests/*/*.json", "model string, n int")
    out = readers.read_summaries(t.spark, f"{path}/summaries/*/*.json", "n_rows long, score double", manifests)
    return out.select("model", "n", "run_dir", "n_rows", "score")


@query(
    "mirror_copies",
    """SELECT c AS copy, o_orderkey, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS price, o_orderpriority,
      lag(o_orderkey) OVER (PARTITION BY c ORDER BY o_orderkey) IS NULL AS is_first FROM orders, (VALUES ('csv'), ('parquet')) v(c)""",
)
def mirror_copies(t):
    """Both copies read back; the smallest key stands at the head of the first file of each."""
    path = new_path(t.spark, "mirror")
    price = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    rows = t.orders.select("o_orderkey", price.alias("price"), "o_orderpriority")
    writers.write_with_mirror(rows, path, ["o_orderkey"])
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    both = None
    for copy in ("parquet", "csv"):
        source = t.spark.read.schema(rows.schema).option("header", True)
        read = source.parquet(f"{path}/parquet") if copy == "parquet" else source.csv(f"{path}/csv")
        read = read.select(F.lit(copy).alias("copy"), *rows.columns, place.alias("place"))
        both = read if both is None else both.unionByName(read)
    heads = both.groupBy("copy").agg(F.min_by("o_orderkey", F.struct("place", "o_orderkey")).alias("head"))
    return both.join(heads, "copy").select("copy", "o_orderkey", "price", "o_orderpriority", (F.col("o_orderkey") == F.col("head")).alias("is_first"))


@query(
    "promoted_snapshot",
    "SELECT o_orderkey, o_orderstatus, '1996' AS snapshot FROM orders WHERE year(o_orderdate) = 1996",
)
def promoted_snapshot(t):
    """Three yearly snapshots; the pointer is set back to the one before the last."""
    root = new_path(t.spark, "snapshots")
    for year in ("1995", "1996", "1997"):
        rows = t.orders.where(F.year("o_orderdate") == int(year)).select("o_orderkey", "o_orderstatus")
        writers.write_snapshot(rows, root, year)
    writers.promote(t.spark, root, "1996")
    return writers.read_latest(t.spark, root).select("o_orderkey", "o_orderstatus", F.col("snapshot").cast("string").alias("snapshot"))


@query(
    "matrix_with_labels",
    "SELECT doc_id, n_chars, length(source) AS source_length, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def matrix_with_labels(t):
    path = new_path(t.spark, "matrix")
    matrix = t.documents.select("doc_id", "n_chars", F.length("source").alias("source_length"))
    writers.training_with_labels(matrix, t.labels, "doc_id", ["quality", "toxic"]).write.parquet(path)
    return t.spark.read.parquet(path)


@query("stored_ensemble", "SELECT vec_id, 2 AS n_seeds, true AS in_range, true AS as_before FROM embeddings")
def stored_ensemble(t):
    """Stored models score all rows as they did before they were stored, whatever the order of columns."""
    df = vectors(t).drop("features")
    before, after = {}, {}
    for seed in (1, 2):
        before[seed] = learn.model_pipeline(COLUMNS, learn.forest_classifier("y", seed=seed)).fit(df)
        path = new_path(t.spark, "model")
        before[seed].write().overwrite().save(path)
        after[seed] = PipelineModel.load(path)
    turned = df.select(*reversed(COLUMNS), "vec_id")
    scores = [learn.ensemble_scores(m, turned, "vec_id", COLUMNS) for m in (before, after)]
    old, new = (rollup.ensemble(s, "vec_id", "proba").select("vec_id", "proba_mean", "n_seeds") for s in scores)
    return new.join(old.select("vec_id", F.col("proba_mean").alias("was")), "vec_id").select(
        "vec_id", F.col("n_seeds").cast("int").alias("n_seeds"), F.col("proba_mean").between(0.0, 1.0).alias("in_range"), (F.abs(F.col("was") - F.col("proba_mean")) < 1e-12).alias("as_before")
    )
