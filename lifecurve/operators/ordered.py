"""Ordered work per key that survives hot keys.

Nearly every operator here needs the rows of a key in order: previous row, running sum, position.
A plain window puts one key into one task, which fails when one key holds a third of the data.
``arrange`` therefore measures the largest key (or takes a bound the caller can prove).

* It fits one task: plain windows, one shuffle on the key.
* It does not fit: rows are range-partitioned by (keys, order), so a hot key spreads over many
  chunks of about equal size, and are written once so that the chunk of a row never changes.
  Running sums add the totals of earlier chunks, frames copy the few rows next to a cut, and
  per-key facts travel through the small (keys, chunk) table. No row-level shuffle uses the key alone.

Both ways give the same rows; the tests run every operator both ways.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lifecurve.session import materialize

CHUNK_ROWS_SETTING = "lifecurve.chunkRows"
DEFAULT_CHUNK_ROWS = 1_000_000
ALL_KEY = "_everything"


def chunk_rows(spark: SparkSession) -> int:
    """Rows of one key that one task may hold."""
    return int(spark.conf.get(CHUNK_ROWS_SETTING, str(DEFAULT_CHUNK_ROWS)))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys; key columns of ``right`` are dropped.

    Without keys both sides are aggregates of one row.
    """
    if not keys:
        left, right = left.withColumn(ALL_KEY, F.lit(1)), right.withColumn(ALL_KEY, F.lit(1))
        return left.join(right, ALL_KEY, how).drop(ALL_KEY)
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Plain equi join for entity keys, which are never null: keeps the partitioning on the key."""
    return left.join(right, list(keys), how)


def with_single(df: DataFrame, single: DataFrame) -> DataFrame:
    """Put the one row of an aggregate without keys beside every row (broadcast of one row).

    Any other number of rows ends the query; none is dropped.
    """
    one = single.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*single.columns)).alias("row"))
    row = F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("one row expected")).cast(one.schema["row"].dataType))
    right = one.select(row.alias("row")).select("row.*").withColumn(ALL_KEY, F.lit(1))
    left = df.withColumn(ALL_KEY, F.lit(1))
    return left.join(F.broadcast(right), ALL_KEY).drop(ALL_KEY)


def spread_before_copies(df: DataFrame, *by: str) -> DataFrame:
    """Hash rows over all shuffle partitions ahead of a fan-out (one row becomes many).

    The rows are small before the copies are made, so the adaptive planner would put them into few
    tasks; an explicit number of partitions is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)


#: Rows that are worth a task of their own where each row is much work.
SPREAD_ROWS = 1024


def spread_evenly(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Rows over as many partitions as ``rows`` are worth, at most the shuffle partitions.

    Ordered steps and small joins leave rows in few partitions, sometimes one per key; costly work per row comes after.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(n, math.ceil(rows / SPREAD_ROWS))), *by)


@dataclass(frozen=True)
class Ordered:
    """Rows with keys and an order; ``chunk`` is set when keys are split over chunks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = None

    @property
    def _parts(self) -> list[str]:
        return [*self.keys, *([self.chunk] if self.chunk else [])]

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self._parts).orderBy(*self.order)

    def add(self, **columns: Column) -> "Ordered":
        """Row-wise columns, evaluated one after another."""
        df = self.df
        for name, expr in columns.items():
            df = df.withColumn(name, expr)
        return replace(self, df=df)

    def where(self, condition: Column) -> "Ordered":
        return replace(self, df=self.df.where(condition))

    def running(self, **sums: Column) -> "Ordered":
        """Sum of each expression from the key's first row through this row."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        names = list(sums)
        if self.chunk is None:
            return replace(
                self, df=self.df.select("*", *[F.sum(e).over(upto).alias(n) for n, e in sums.items()])
            )
        totals = self.df.groupBy(*self._parts).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(self.chunk)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = totals.select(
            *self._parts, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
        )
        joined = join_same(self.df, offsets, self._parts)
        out = joined.select(
            "*", *[(F.sum(e).over(upto) + F.col(f"_o_{n}")).alias(n) for n, e in sums.items()]
        ).drop(*[f"_o_{n}" for n in names])
        return replace(self, df=out)

    def position(self, name: str) -> "Ordered":
        """1-based row number within the key."""
        if self.chunk is None:
            out = self.df.withColumn(name, F.row_number().over(self._window()).cast("long"))
            return replace(self, df=out)
        return self.running(**{name: F.lit(1).cast("long")})

    def attach(self, **aggregates: Column) -> "Ordered":
        """Per-key aggregates repeated on every row."""
        if self.chunk is None:
            whole = Window.partitionBy(*self.keys)
            return replace(
                self, df=self.df.select("*", *[a.over(whole).alias(n) for n, a in aggregates.items()])
            )
        facts = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggregates.items()])
        spread = join_same(self.df.select(*self._parts).distinct(), facts, self.keys)
        return replace(self, df=join_same(self.df, spread, self._parts))

    def carried(self, name: str, value: Column, *, ahead: bool = False) -> "Ordered":
        """Nearest non-null value at or before this row (``ahead``: at or after it)."""
        first, last = Window.unboundedPreceding, Window.unboundedFollowing
        frame = (Window.currentRow, last) if ahead else (first, Window.currentRow)
        pick = F.first if ahead else F.last
        local = pick(value, ignorenulls=True).over(self._window().rowsBetween(*frame))
        if self.chunk is None:
            return replace(self, df=self.df.withColumn(name, local))
        at = F.when(value.isNotNull(), F.struct(*self.order))
        edge = F.min_by(value, at) if ahead else F.max_by(value, at)
        per_chunk = self.df.groupBy(*self._parts).agg(edge.alias("_edge"))
        others = (1, last) if ahead else (first, -1)
        w = Window.partitionBy(*self.keys).orderBy(self.chunk).rowsBetween(*others)
        carry = per_chunk.select(*self._parts, pick("_edge", ignorenulls=True).over(w).alias("_carry"))
        df = join_same(self.df, carry, self._parts)
        return replace(self, df=df.withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_carry"))

    def join_facts(self, facts: DataFrame) -> "Ordered":
        """Left join a table that is unique on the keys."""
        if self.chunk is None:
            return replace(self, df=join_on(self.df, facts, self.keys, "left"))
        spread = join_same(self.df.select(*self._parts).distinct(), facts, self.keys, "left")
        return replace(self, df=join_same(self.df, spread, self._parts))

    def frames(self, before: int, after: int, **columns: Callable[[WindowSpec], Column]) -> "Ordered":
        """Window columns whose frames reach at most ``before`` rows back and ``after`` ahead."""
        if self.chunk is None:
            w = self._window()
            return replace(self, df=self.df.select("*", *[f(w).alias(n) for n, f in columns.items()]))
        size = max(chunk_rows(self.df.sparkSession), before, after, 1)
        at = self.position("_frame_pos").df
        home = F.floor((F.col("_frame_pos") - 1) / size).cast("long")
        inside = (F.col("_frame_pos") - 1) - home * size
        copies = F.array_compact(
            F.array(
                home,
                F.when((inside < after) & (home > 0), home - 1),
                F.when(inside >= size - before, home + 1),
            )
        )
        spread = at.withColumn("_frame_home", home).withColumn("_frame_no", F.explode(copies))
        w = Window.partitionBy(*self.keys, "_frame_no").orderBy("_frame_pos")
        out = (
            spread.select("*", *[f(w).alias(n) for n, f in columns.items()])
            .where(F.col("_frame_no") == F.col("_frame_home"))
            .drop("_frame_pos", "_frame_home", "_frame_no")
        )
        return replace(self, df=out)

    def rows(self) -> DataFrame:
        """The rows without helper columns."""
        return self.df.drop(*[c for c in (self.chunk, ALL_KEY) if c])


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all): one pass, map-side combined."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return int(row["top"] or 0), int(row["total"] or 0)


def fits(df: DataFrame, keys: Sequence[str], bound: int | None = None) -> bool:
    """True when every key provably fits one task: by the caller's bound, else by counting."""
    limit = chunk_rows(df.sparkSession)
    if bound is not None and bound <= limit:
        return True
    return largest_group(df, keys)[0] <= limit


def arrange(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, bound: int | None = None
) -> Ordered:
    """Put rows in order per key. ``bound`` is a proven limit on the rows of any key."""
    if not keys:
        df, keys = df.withColumn(ALL_KEY, F.lit(1)), [ALL_KEY]
    limit = chunk_rows(df.sparkSession)
    if bound is not None and bound <= limit:
        return Ordered(df, tuple(keys), tuple(order))
    top, total = largest_group(df, keys)
    if top <= limit:
        return Ordered(df, tuple(keys), tuple(order))
    chunks = max(2, math.ceil(total / limit))
    ranged = df.repartitionByRange(chunks, *keys, *order).withColumn(
        "_chunk", F.spark_partition_id()
    )
    return Ordered(materialize(ranged), tuple(keys), tuple(order), "_chunk")


def join_per_key(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", *, bound: int | None = None
) -> DataFrame:
    """Join rows with a table that is unique on the keys, ahead of an aggregate on the same keys.

    Such an aggregate needs no exchange after the join, so the adaptive planner cannot split a hot key.
    When some key does not fit one task, rows are salted by a hash of their content and the facts are
    repeated once per salt; the aggregate then combines on the map side.
    """
    limit = chunk_rows(rows.sparkSession)
    top = bound if bound is not None and bound <= limit else largest_group(rows, keys)[0]
    if top <= limit:
        return join_on(rows, facts, keys, how)
    salts = math.ceil(top / limit)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_on(salted, repeated, [*keys, "_salt"], how).drop("_salt")
