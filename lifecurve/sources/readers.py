"""Readers: nested documents, samples, registries, decision maps, snapshots and run folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifecurve.functions.roles import DECISION, DOCUMENT, OUTLIER_ENTRY
from lifecurve.sources.writers import entity_bucket

REGULAR = "regular_cd"
CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects). One JSON document per file, or per line: many small files are slow to list.

    A malformed document becomes a reject row. A missing folder fails, as Spark reports it.
    """
    schema = T.StructType([*DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    good = raw.where(F.col(CORRUPT).isNull() & F.col("cell_name").isNotNull()).drop(CORRUPT)
    bad = raw.where(F.col(CORRUPT).isNotNull() | F.col("cell_name").isNull()).select("source_file", CORRUPT)
    return good, bad


def flatten_cycles(documents: DataFrame, kind: str = REGULAR) -> DataFrame:
    """One row per regular cycle: right kind, ordinal and discharge present."""
    return (
        documents.select("cell_name", F.explode("cd_events").alias("e"))
        .where(
            (F.col("e.event_kind") == kind)
            & F.col("e.regular_cycle").isNotNull()
            & F.col("e.capacity_discharge_ah").isNotNull()
        )
        .select("cell_name", "e.*")
    )


def flatten_regimes(documents: DataFrame) -> DataFrame:
    return documents.select(
        "cell_name", F.posexplode("regular_rate_regimes").alias("pos", "r")
    ).select("cell_name", "pos", "r.*")


def cell_header(documents: DataFrame) -> DataFrame:
    """Per-cell facts of the label build."""
    return documents.select(
        "cell_name",
        F.coalesce("cycling_consistency", F.lit("no_regular")).alias("cycling_consistency"),
        F.coalesce("protocol_pattern", F.lit("other")).alias("protocol_pattern"),
        F.get(F.col("regular_rate_regimes"), 0)["n_regular_cd"].alias("first_regime_n"),
    )


def read_samples(
    spark: SparkSession, path: str, columns: Sequence[str], entities: DataFrame | None = None,
    entity: str = "cell_name", *, schema: T.StructType | str | None = None,
) -> DataFrame:
    """Raw samples, core columns only, restricted to wanted entities by a semi join.

    With a schema no footer is read while planning, and columns that old files lack are null.
    """
    source = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    df = source.parquet(path).select(*columns)
    return df if entities is None else df.join(entities.select(entity).distinct(), entity, "left_semi")


def read_indexed_samples(
    spark: SparkSession, path: str, columns: Sequence[str], entities: DataFrame, entity: str, *, schema: T.StructType | str, buckets: int | None = None,
) -> DataFrame:
    """The samples of the wanted entities, from those files only that the index of ``write_samples`` does not rule out.

    Wanted entities meet the index by equal hash bucket, inside its range; what reaches the driver is the names of
    the files, which it needs to plan the scan anyway. The semi join stays, since a bucket may hold others.
    """
    wanted = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
    bucket = entity_bucket(F.col(entity)) if buckets is None else entity_bucket(F.col(entity), buckets)
    near = spark.read.parquet(f"{path}/index").join(wanted.withColumn("bucket", bucket), "bucket")
    files = [r["file"] for r in near.where(F.col(entity).between(F.col("low"), F.col("high"))).select("file").distinct().collect()]
    source = spark.read.schema(schema)
    df = source.parquet(*[f"{path}/samples/{f}" for f in sorted(files)]) if files else source.parquet(f"{path}/samples").limit(0)
    return df.select(*columns).join(wanted, entity, "left_semi")


def read_registry(
    df: DataFrame, kind: str | None = REGULAR, columns: Sequence[str] | None = None, kind_column: str = "event_kind"
) -> DataFrame:
    """Registry rows of one event kind, projected; filter and projection reach the scan."""
    if kind is not None:
        df = df.where(F.col(kind_column) == kind)
    return df.select(*columns) if columns else df


def read_second_labels(df: DataFrame, renames: dict[str, str], lower: Sequence[str] = ()) -> DataFrame:
    """A second labeling: columns renamed, listed text columns lower-cased."""
    out = df.select(*[F.col(old).alias(new) for old, new in renames.items()])
    return out.withColumns({c: F.lower(c) for c in lower}) if lower else out


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def explode_json_map(text: Column, value: T.DataType) -> Column:
    """Generator: (key, value) rows of a JSON object held as text."""
    return F.explode(F.from_json(text, T.MapType(T.StringType(), value)))


def read_decisions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Decision map file -> one row per cell; a missing file gives no rows.

    The map is one JSON value, hence one row of one task. ``lines`` reads one object per cell and line
    instead (``cell_name`` beside the fields), which splits over tasks.
    """
    schema = T.StructType([T.StructField("cell_name", T.StringType()), *DECISION.fields])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if lines:
        return spark.read.schema(schema).json(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(explode_json_map(F.col("value"), DECISION).alias("cell_name", "d")).select("cell_name", "d.*")


def read_outliers(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Outlier sidecar -> (cell_name, cycle, z_score) rows; a missing file gives no rows.

    ``lines``: one object per cell and line, as in ``read_decisions``.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "cell_name string, cycle long, z_score double")
    if lines:
        entries = spark.read.schema(T.StructType([T.StructField("cell_name", T.StringType()), *OUTLIER_ENTRY.fields])).json(path)
    else:
        text = spark.read.text(path, wholetext=True)
        entries = text.select(explode_json_map(F.col("value"), OUTLIER_ENTRY).alias("cell_name", "o")).select("cell_name", "o.*")
    return entries.select("cell_name", F.explode("outliers").alias("x")).select("cell_name", "x.*")


def snapshot_choice(
    files: DataFrame, required: Sequence[str], latest: str | None = None, flat: str = ""
) -> DataFrame:
    """At most one row: the snapshot to read among the complete ones of a (snapshot, file) table.

    The pointer wins if its snapshot is complete, then the newest name, then the flat layout
    (rows whose snapshot is ``flat``).
    """
    complete = (
        files.where(F.col("file").isin(*required))
        .groupBy("snapshot")
        .agg(F.count_distinct("file").alias("n_files"))
        .where(F.col("n_files") == len(required))
    )
    place = F.when(F.col("snapshot") == flat, 2).otherwise(1)
    if latest is not None:
        place = F.when(F.col("snapshot") == latest, 0).otherwise(place)
    return complete.orderBy(place, F.col("snapshot").desc()).limit(1)


def resolve_snapshot(
    files: DataFrame,
    required: Sequence[str],
    pinned: str | None = None,
    latest: str | None = None,
    flat: str = "",
) -> str | None:
    """Name of the snapshot to read; a pinned one is taken as it is, else the pointer is the fallback."""
    if pinned is not None:
        return pinned
    row = snapshot_choice(files, required, latest, flat).first()
    return row["snapshot"] if row else latest


def find_runs(manifests: DataFrame, **wanted) -> DataFrame:
    """Runs whose manifest fields equal the given values; a value of None does not filter."""
    for column, value in wanted.items():
        if value is not None:
            manifests = manifests.where(F.col(column) == value)
    return manifests


def read_manifests(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """Run manifests with the run folder taken from the path."""
    raw = spark.read.schema(schema).option("multiLine", True).json(glob)
    return raw.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_summaries(
    spark: SparkSession, glob: str, schema: T.StructType | str, manifests: DataFrame | None = None
) -> DataFrame:
    """Run summaries, optionally enriched with their manifest."""
    out = read_manifests(spark, glob, schema)
    if manifests is None:
        return out
    extra = [c for c in manifests.columns if c == "run_dir" or c not in out.columns]
    return out.join(manifests.select(*extra), "run_dir", "left")


def path_part(path: Column, axis: str) -> Column:
    """Value of ``axis`` in a path such as ``.../N=200/model=rf/...``."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){axis}=([^/]+)", 1), F.lit(""))
