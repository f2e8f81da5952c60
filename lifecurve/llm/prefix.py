"""Prefixes of sets whose elements are ordered by rarity: two sets of a likeness share an element of their prefixes.

Of two sets of Jaccard likeness ``least`` or more the smaller one's first n - ceil(2 least / (1 + least) n) + 1 elements
(indexed) and the larger one's first m - ceil(least m) + 1 have one in common, in any order that all sets share. With the
rarest first, what many sets hold stands at the end and makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Against rounding of the shares of a size; a prefix may be longer than needed, not shorter.
SPARE = 1e-9


def prefixes(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The prefix rows of ``rows`` (node, sh), with all of ``nodes`` (node, size, ...), ``at`` (place from 0) and ``indexed``.

    Elements of a single set come first in its order and are left out: they meet nothing.
    """
    often = rows.groupBy("sh").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    order = Window.partitionBy("node").orderBy("sets", "sh")
    ranked = rows.join(often, "sh").select("node", "sh", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("n_shared"))
    placed = ranked.join(nodes, "node").withColumn("at", F.col("size") - F.col("n_shared") + F.col("rank") - 1)
    most = lambda share: F.col("size") - F.ceil(F.col("size") * F.lit(share - SPARE))
    prefix = placed.where(F.col("at") <= most(least))
    return prefix.withColumn("indexed", F.col("at") <= most(2 * least / (1 + least))).drop("rank", "n_shared")


def can_reach(least: float) -> Column:
    """Of prefix rows x (indexed) and y that share an element: x is the smaller set, and both have enough left for the likeness."""
    smaller = F.struct("x.size", "x.node") < F.struct("y.size", "y.node")
    needed = (F.col("x.size") + F.col("y.size")) * F.lit(least / (1 + least) - SPARE)
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))  # this element and those behind it
    return smaller & (F.col("x.size") >= F.col("y.size") * F.lit(least - SPARE)) & (rest >= needed)
