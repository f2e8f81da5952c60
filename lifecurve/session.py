"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "12g", app: str = "lifecurve") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        # Methods above this size are never compiled by the JIT; evaluate them outside the fused stage.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


WORK_SETTING = "lifecurve.workDir"


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme as Spark reads it: in the default file system, which need not be the machine's own."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    said = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString()
    return f"file://{said[5:]}" if said.startswith("file:/") and not said.startswith("file://") else said


def working_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the one the cluster names, else the session's own setting.

    A temporary folder is made and set only in local mode, where driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_SETTING, None)
    if named:
        return named if "://" in named else qualified(spark, named)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir or {WORK_SETTING} to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="lifecurve-")
    spark.conf.set(WORK_SETTING, made)
    return made


#: Folders made below the working folder, in order.
_MADE: list[str] = []


def new_path(spark: SparkSession, kind: str) -> str:
    """A folder name below the working folder that no other run uses."""
    path = f"{working_folder(spark).rstrip('/')}/lifecurve/{kind}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the working folder and read it back (columnar, lineage cut)."""
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_since(count: int = 0) -> list[str]:
    """The working folders made so far, without the first ``count``; ``len(made_since())`` is the mark to count from."""
    return _MADE[count:]


def release(spark: SparkSession, folders: list[str], keep: DataFrame | None = None) -> list[str]:
    """Delete working folders that are done with, except those that ``keep`` reads; the folders that are left.

    Call it only where nothing else that is still to be read comes from these folders.
    """
    read = "\n".join(keep.inputFiles()) if keep is not None else ""
    left, jvm, conf = [], spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if folder.rsplit("/", 1)[-1] in read:
            left.append(folder)
            continue
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _MADE:
            _MADE.remove(folder)
    return left
