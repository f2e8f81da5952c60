"""Small helpers of the text operators: bounded Arrow batches, shared files, tables that cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifecurve.session import made_since, materialize, new_path, release

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

__all__ = ["add_row", "lower_ascii", "map_slices", "materialize", "open_folder", "put_file", "numbered_once", "ready", "slices", "spare", "texts", "without_leftovers", "work_path"]


def map_slices(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so very long texts do not add up in a worker."""
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ready(spark: SparkSession) -> None:
    """Bound Arrow batches, and let workers that start later find this package where the driver has it."""
    spark.conf.set(BATCH_BYTES, "16m")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one slice holds few megabytes (or a single row)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null is the empty text."""
    return [v or "" for v in batch.column(column).to_pylist()]


def add_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row of a file scan, so repeated and null ids stay apart.

    The numbers follow the files' splits, and these the cores that are there: where a second plan needs the
    numbers again, it must read them from a written table (``numbered_once``).
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered_once(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written once, and the name of that column: whoever reads it sees the same numbers."""
    name = spare(df, name)
    return materialize(add_row(df, name)), name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def work_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared working folder."""
    return new_path(spark, kind)


def without_leftovers(fn):
    """``fn(docs, ...)`` whose working tables are deleted as soon as it returns, except those that its result reads."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        mark = len(made_since())
        out = fn(docs, *args, **options)
        release(docs.sparkSession, made_since(mark), keep=out)
        return out

    return run


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in the shared store (file, hdfs, s3, gs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, parts: Iterator[bytes]) -> int:
    """Write a file under a passing name and move it in place.

    A second attempt of the task writes the same bytes, so whichever move comes last is right.
    """
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    passing, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(passing, f"{path}/{name}")
    return size
