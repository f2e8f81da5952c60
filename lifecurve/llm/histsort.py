"""Sharding by histogram sort: shards of near equal bytes in key order (operator 11).

The sort key of a row is a string of hex digits: 16 of the MD5 of its text, 16 of the MD5 of its id, and beyond
those the MD5 of its row number, which only rows equal in text and id ever need. So equal texts are neighbours,
and lie in one shard unless a boundary has to cut them (a group of copies may be larger than a shard).

1. Candidate boundaries are the ``DIGITS`` first digits of keys. One aggregate counts the exact bytes in each cell
   between two of them; running sums give the bytes below each boundary.
2. For each of the shards - 1 targets (k / shards of all bytes) the cell that holds it is found. If the nearer of
   its two ends is within ``tolerance`` of a shard's size, that end is the splitter.
3. If not, the cell becomes the next interval, and only its rows are counted again, by ``DIGITS`` more digits. It ends
   when all targets are met, or the cell is one row, which cannot be cut.
4. Rows are exchanged once, by range of (shard, key), and numbered gapless within their shard.

The driver sees one row per open splitter and round; the cells stay a table. Only DataFrame functions are used.

Odd input: a null text is an empty one (16 bytes in all), a null id an empty name; repeated rows are rows of their
own; with fewer rows than shards some shards are empty; an empty table gives no rows; other columns are
ignored by ``assign`` and kept by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.llm.common import add_row, materialize
from lifecurve.llm.ranges import numbered

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.01
DIGITS = 3
KEY_DIGITS = 32
MOST_DIGITS = KEY_DIGITS + 32
#: Sorts behind every hex digit: a boundary at the end of a cell is its digits and this.
END = "~"


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(_row, doc_id, size, text_crc32, key) of documents that have a _row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    name = F.coalesce(doc.cast("string"), F.lit(""))
    key = F.concat(F.substring(F.md5(text), 1, KEY_DIGITS // 2), F.substring(F.md5(name), 1, KEY_DIGITS // 2))
    return docs.select("_row", doc.alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))


def whole_key() -> Column:
    """All digits that tell rows apart."""
    return F.concat("key", F.md5(F.col("_row").cast("string")))


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[str]:
    """The shards - 1 boundaries of (_row, size, key): a row belongs behind those that are not above its key."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return [END] * (shards - 1)
    # Targets are whole numbers in parts of a byte, so nothing is rounded.
    allowed = tolerance * total
    inside = dict.fromkeys(range(1, shards), ("", 0))  # of each open target: the interval's digits, and the bytes below it
    done: dict[int, str] = {}
    for depth in range(DIGITS, MOST_DIGITS + DIGITS, DIGITS):
        if not inside:
            break
        key = whole_key() if depth > KEY_DIGITS else F.col("key")
        parts = rows.select(F.substring(key, 1, depth - DIGITS).alias("parent"), F.substring(key, 1, depth).alias("cell"), "size")
        parts = parts.where(F.col("parent").isin(sorted({p for p, _ in inside.values()})))
        cells = parts.groupBy("parent", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("below", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
        open_now = [(k, p, k * total - base * shards, base) for k, (p, base) in inside.items()]
        wanted = spark.range(1, numPartitions=1).select(F.inline(F.array(*[_target(*x) for x in open_now])))
        hit = cells.join(F.broadcast(wanted), "parent").where((F.col("below") * shards < F.col("aim")) & (F.col("aim") <= (F.col("below") + F.col("bytes")) * shards))
        left = {}
        for r in hit.select("k", "cell", "bytes", "n", "below", "aim", "base").collect():
            before, after = r["aim"] - r["below"] * shards, (r["below"] + r["bytes"]) * shards - r["aim"]
            if min(before, after) <= allowed or r["n"] == 1 or depth >= MOST_DIGITS:
                done[r["k"]] = r["cell"] + (END if after < before else "")
            else:
                left[r["k"]] = (r["cell"], r["base"] + r["below"])
        inside = left
    return [done[k] for k in sorted(done)]


def _target(k: int, parent: str, aim: int, base: int) -> Column:
    """One open target as a struct; there are shards - 1 at most."""
    return F.struct(F.lit(k).alias("k"), F.lit(parent).alias("parent"), F.lit(aim).cast("long").alias("aim"), F.lit(base).cast("long").alias("base"))


def shard_of(key: Column, bounds: list[str], first: int = 0) -> Column:
    """The number of bounds that are not above the key, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], shard_of(key, bounds[:mid], first)).otherwise(shard_of(key, bounds[mid + 1 :], first + mid + 1))


def placed(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The written table ``rows`` of ``keyed`` with shard and slot, exchanged once."""
    bounds = splitters(rows, shards, tolerance)
    deep = any(len(b) > KEY_DIGITS for b in bounds)
    dealt = rows.withColumn("shard", shard_of(whole_key() if deep else F.col("key"), bounds).cast("int"))
    return numbered(dealt.withColumn("last", F.md5(F.col("_row").cast("string"))), ["shard"], ["key", "doc_id", "last"], "slot").drop("last")


def assign(docs: DataFrame, *, shards: int = SHARDS, tolerance: float = TOLERANCE, **columns) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = materialize(keyed(add_row(docs), **columns))
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return placed(rows, shards, tolerance).select("doc_id", "size", "text_crc32", *law)


def sharded(docs: DataFrame, *, shards: int = SHARDS, tolerance: float = TOLERANCE, names: tuple[str, str] = ("shard", "slot"), **columns) -> DataFrame:
    """The documents themselves with shard and slot under the given names, for a write partitioned by shard.

    Rows are numbered in one written table, which both the decision and the join read.
    """
    shard, slot = names
    taken = [c for c in docs.columns if c.lower() in {shard.lower(), slot.lower(), "_row"}]
    if taken:
        raise ValueError(f"columns {taken} are in the way; drop them or give other names")
    whole = materialize(add_row(docs))
    rows = materialize(keyed(whole, **columns))
    found = placed(rows, shards, tolerance).select("_row", F.col("shard").alias(shard), F.col("slot").alias(slot))
    return whole.join(found, "_row").drop("_row")


def shard_report(placed_rows: DataFrame) -> DataFrame:
    """shard, n_rows, n_bytes, first_slot, last_slot."""
    return placed_rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


__all__ = ["assign", "keyed", "placed", "shard_of", "shard_report", "sharded", "splitters"]
