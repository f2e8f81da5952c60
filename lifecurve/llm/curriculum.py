"""Mixing sources to target weights by a curriculum that changes over training time (operator 8).

Sizes are words. Source k of n (by code point, null last) has weight ``weights[k % len(weights)]``; the mix has
``share`` times all words. A source's target is its part of that by weight, but at most ``most`` times its size;
what is above goes to the others by weight until none is above. Ordered by size over weight this has a closed
form: the sources below a common level are capped, all others get level times weight.

A source's documents are taken in a fixed pseudo-random order (MD5 of doc_id), pass after pass; the last
pass ends where the target is reached, at the nearest whole document. Each source has a weight schedule over
training time 0..1, a line through ``ramps[k % len(ramps)]`` (start, end). Its integral is the source's
cumulative demand; a word that has c of the source's taken words before it is due when the integral reaches
c / taken, so inverting it gives the time, and the demand of all sources up to that time the position.
``mixed`` copies the documents taken and sorts them by position over ranges.

Only functions of columns are used. Running sums over a hot source are made within chunks of bounded
expected size and carried by the chunk totals. Odd input: null texts have no words and are taken in whole
passes only; null doc_ids order as an empty name; rows equal in all columns used are told apart by row; an
empty table gives no rows; without any words every target is zero; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.llm.common import materialize, numbered_once, spare, without_leftovers

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: (start, end) of the weight's multiplier over training time; each has the mean 1.
RAMPS = ((0.5, 1.5), (1.5, 0.5), (1.0, 1.0))
CHUNK_ROWS = 1 << 12


def word_count(text: Column) -> Column:
    """Number of runs of anything but blank and the control signs 9 to 13; null has none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (inner == ""), 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def by_turn(values, rank: Column) -> Column:
    """values[rank % n] as a column."""
    turn = F.pmod(rank, F.lit(len(values)))
    return reduce(lambda rest, kv: F.when(turn == kv[0], F.lit(kv[1])).otherwise(rest), list(enumerate(values))[:-1], F.lit(values[-1]))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", by_turn([float(w) for w in weights], F.col("rank")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    steps = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("all"),
        F.coalesce(F.sum("cap").over(filling), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))).alias("open"),
    )
    level = (F.col("all") - F.col("full")) / F.col("open")
    # The level if this source is the first that is not full; the right one is the first that fits.
    fits = F.when(F.col("cap") / F.col("weight") >= level, F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", level.alias("level")))
    steps = steps.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return steps.select("source", "source_size", "rank", target.alias("target"))


def time_of(part: Column, start: Column, end: Column) -> Column:
    """When a schedule from ``start`` to ``end`` has had ``part`` of its whole integral (mean times one)."""
    mean, slope = (start + end) / 2, end - start
    # start t + slope t^2 / 2 = part mean, solved without a difference of near values
    return 2 * part * mean / (start + F.sqrt(start * start + 2 * slope * part * mean))


def integral(t: Column, start: float, end: float) -> Column:
    """Part of the whole integral up to time t."""
    return (F.lit(start) * t + F.lit((end - start) / 2) * t * t) / F.lit((start + end) / 2)


def plan_mix(
    docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, ramps=RAMPS, chunk_rows: int = CHUNK_ROWS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """One row per document: _row, doc_id, size, source_size, target, passes, taken, position.

    passes: how often the document is taken; taken = passes * size; position: the words all sources have
    given before its first use (null if it is not taken); times: training time of each use.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(
        row.alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    rows = materialize(rows.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    facts = materialize(targets(totals.select("source", "source_size"), weights, share, most))
    largest = totals.agg(F.max("n")).first()[0] or 0
    chunks = max(1, math.ceil(largest / chunk_rows))
    digits = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    chunked = rows.withColumn("chunk", F.floor(digits * chunks / F.lit(1 << 32)).cast("int"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("s"))
    offsets = sums.select("source", "chunk", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    facts = facts.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_chunk = _join_source(offsets, facts)
    within = Window.partitionBy("_src", "chunk").orderBy("turn", "_row").rowsBetween(Window.unboundedPreceding, -1)
    named = chunked.select("*", F.struct("source").alias("_src")).drop("source")
    running = named.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = running.join(per_chunk, ["_src", "chunk"])
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    begin = F.col("before") + F.col("inside")
    more = (F.col("size") > 0) & (begin + F.col("size") / 2 <= rest)
    passes = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long")
    out = placed.select("_row", "doc_id", "size", "source_size", "target", "rank", begin.alias("begin"), passes.alias("passes"))
    start, end = by_turn([float(a) for a, _ in ramps], F.col("rank")), by_turn([float(b) for _, b in ramps], F.col("rank"))
    use = lambda k: F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("begin") + k * F.col("source_size")) / F.col("target"))).otherwise(0.0)
    times = F.transform(F.sequence(F.lit(0), F.col("passes").cast("int") - 1), lambda k: time_of(use(k), start, end))
    out = out.withColumn("times", F.when(F.col("passes") > 0, times))
    demand = facts.groupBy(F.pmod("rank", F.lit(len(ramps))).alias("k")).agg(F.sum("target").alias("d"))
    sums = demand.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("d"))), F.lit(0.0)).alias(f"d{k}") for k in range(len(ramps))])
    given = sums.first()
    position = reduce(lambda a, b: a + b, [F.lit(given[k]) * integral(F.col("times")[0], float(a), float(b)) for k, (a, b) in enumerate(ramps)])
    taken = F.col("passes") * F.col("size")
    return out.select("_row", "doc_id", "size", "source_size", "target", "passes", taken.alias("taken"), position.alias("position"), "times")


def _join_source(offsets: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunk offsets with the facts of their source; sources sit in a struct so that null meets null."""
    left = offsets.select(F.struct("source").alias("_src"), "chunk", "before")
    return left.join(facts.select(F.struct("source").alias("_src"), "source_size", "rank", "target", "whole"), "_src")


@without_leftovers
def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training order: every document as often as it is taken, range-sorted by time of use."""
    numbered, row = numbered_once(docs, "_op8_row")
    time = spare(numbered, "_op8_time")
    plan = plan_mix(numbered, row_col=row, **options).where("passes > 0").select(F.col("_row").alias(row), F.explode("times").alias(time))
    return _in_order(numbered.join(plan, row), time, row).drop(time, row)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """``plan_mix`` by the position of each document's first use, range-sorted; documents that are not taken come last."""
    return _in_order(plan_mix(docs, **options), F.col("position").asc_nulls_last(), "_row")


def _in_order(df: DataFrame, *by) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
