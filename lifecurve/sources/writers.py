"""Writers: parquet with a csv mirror, snapshots with a pointer, keyed upsert, wide outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value at rest."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def write_with_mirror(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Parquet and csv copies; rows in a fixed order, nulls last.

    The ordered rows are kept on disk between the two writes, so the plan and its sort run once; parts on a
    lost executor are computed again.
    """
    out = nan_to_null(df)
    if order:
        out = out.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    out = out.persist(StorageLevel.DISK_ONLY)
    try:
        out.write.mode("overwrite").parquet(f"{path}/parquet")
        out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    finally:
        out.unpersist()


#: Hash buckets of entities in a sample index.
INDEX_BUCKETS = 1 << 16


def entity_bucket(entity: Column, buckets: int = INDEX_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(entity.cast("string")), F.lit(buckets)).cast("int")


def write_samples(df: DataFrame, path: str, entity: str, order: Sequence[str] = (), *, files: int | None = None, buckets: int = INDEX_BUCKETS) -> int:
    """Samples by ranges of (entity, order), and beside them a skipping index; the number of files.

    The index has a row per file and hash bucket of its entities (a Bloom filter of one hash, kept as rows), with
    the least and greatest entity of each: a reader that looks for an entity opens only files that can hold it.
    An entity with very many samples spreads over several files by its order.
    """
    spark = df.sparkSession
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(count, entity, *order).sortWithinPartitions(entity, *order).write.mode("overwrite").parquet(f"{path}/samples")
    rows = spark.read.schema(df.schema).parquet(f"{path}/samples")
    name = F.col("_metadata.file_name")
    found = rows.where(F.col(entity).isNotNull()).groupBy(name.alias("file"), entity_bucket(F.col(entity), buckets).alias("bucket"))
    found.agg(F.min(entity).alias("low"), F.max(entity).alias("high"), F.count(F.lit(1)).alias("n_samples")).write.mode("overwrite").parquet(f"{path}/index")
    return len(rows.inputFiles())


def write_snapshot(df: DataFrame, root: str, snapshot: str) -> None:
    """Write one snapshot partition, then move the pointer: a failed write leaves the old pointer."""
    nan_to_null(df).write.mode("overwrite").parquet(f"{root}/snapshots/snapshot={snapshot}")
    promote(df.sparkSession, root, snapshot)


def promote(spark: SparkSession, root: str, snapshot: str) -> None:
    """Add a pointer row; the newest one counts, so there is no moment without a pointer."""
    pointer = spark.range(1).select(
        F.lit(snapshot).alias("snapshot"), F.current_timestamp().alias("promoted_at")
    )
    pointer.write.mode("append").parquet(f"{root}/latest")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The promoted snapshot; the filter prunes partitions."""
    pointers = spark.read.parquet(f"{root}/latest")
    name = pointers.agg(F.max_by("snapshot", "promoted_at").alias("snapshot")).first()["snapshot"]
    return spark.read.parquet(f"{root}/snapshots").where(F.col("snapshot") == name)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables; the new row wins on a shared key, the last by ``_seq`` inside one table, and
    without ``_seq`` the greatest by its values, so that reruns agree.

    Columns missing on one side become null. One mergeable aggregate, so a key with many versions
    is combined on the map side.
    """
    both = old.withColumn("_generation", F.lit(0)).unionByName(
        new.withColumn("_generation", F.lit(1)), allowMissingColumns=True
    )
    version = [c for c in ("_generation", "_seq") if c in both.columns]
    values = [c for c in both.columns if c not in (*keys, *version)]
    newest = F.max_by(F.struct(*values), F.struct(*version, *values)).alias("_row")
    return both.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def wide_predictions(spine: DataFrame, blocks: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """One row per entity with every prediction block joined on, in a fixed column order."""
    for block in blocks:
        spine = spine.join(block, key, "left")
    return spine.select(key, *columns)


def training_with_labels(matrix: DataFrame, labels: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The training matrix with label columns alongside."""
    return matrix.join(labels.select(key, *columns), key, "left")
