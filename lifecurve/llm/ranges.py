"""Gapless numbers within groups by one range exchange.

Rows are range-partitioned and sorted by (group, order), written once with their place in the partition, and the
row counts of each (group, partition) are summed before it. No group has to fit one task: a hot group spreads
over as many partitions as its rows need, provided the order tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.llm.common import materialize

_PLACE_BITS = 33  # of monotonically_increasing_id: partition above, place in it below


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in its group by ``order``, nulls first.

    ``df`` should be a written table: Spark reads it once for the ranges and once for the exchange. Without a
    group the numbers run over the whole table. Groups may be null. Rows equal in all of ``order`` are numbered
    in any order. Columns named ``_at``, ``_part``, ``_before`` and ``_group`` are used in between.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", _PLACE_BITS)).withColumn("_group", F.struct(F.lit(0).alias("_"), *group))
    found = laid.groupBy("_group", "_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = materialize(found.select("_group", "_part", before.alias("_before")))
    return laid.join(shifts, ["_group", "_part"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_part", "_before", "_group")
