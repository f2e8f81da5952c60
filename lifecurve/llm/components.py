"""Connected components of a table of links, by alternating stars.

Each round hangs the larger neighbours of every node on its smallest one, then the smaller neighbours
likewise, until the links no longer change: log(n) rounds in practice, each a few grouped minima and joins.
No group is ever gathered: minima combine on the map side, the joins are of two shuffled sides, which the
adaptive planner splits where a node has very many links. Every round is written to the working folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import materialize


def _outward(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked with the smallest of its neighbours and itself."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _inward(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, with that smallest one.

    ``links`` has two columns a and b of one comparable type; the direction, repeats and links of a node
    with itself do not matter. No links give no rows.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    now = materialize(links.select("a", "b").where("a <> b").distinct())
    seen = mark(now)
    while seen[0]:
        now = materialize(_inward(_outward(now)))
        again = mark(now)
        if again == seen and now.groupBy("a").count().where("count > 1").isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        seen = again
    return now
