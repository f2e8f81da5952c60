"""Exact deduplication through a minimal perfect hash of the distinct digests of a history (operator 10).

1. Every text becomes the SHA-256 of its normalised bytes (A-Z in lower case); texts are not moved.
2. The history's distinct digests, with winner and count combined on the map side, are dealt to buckets by
   their first bytes. For each bucket a task builds a minimal perfect hash: level by level every digest not
   placed yet is hashed into a bit field, fields hit once keep theirs, the others go to the next level; a
   digest's slot is the number of set bits before its own. A slot holds the full digest and the locator of
   the winner (its doc_id and row) with the group's size. The files lie in the shared working folder.
3. Rows are dealt to the same buckets by a rebalancing exchange, which splits hot buckets over many tasks;
   each task reads the index of its bucket, looks the digest up and compares all 32 bytes. Members are
   repeats of what the slot says; nonmembers are grouped among themselves.

Without another history the documents are their own: all rows are members and the winner is the row with
the largest doc_id. Odd input: null is the empty text; a null doc_id loses against any other; of equal
doc_ids one row stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, numbered_once, open_folder, put_file, slices, texts, without_leftovers, work_path
from lifecurve.llm.simhash import LOWER

BUCKET_DIGESTS = 250_000
LEAST_DIGESTS = 2_000
MOST_SMALL = 64
SPREAD = 1.5
NO_ID = np.iinfo(np.int64).min


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest (a row of 32 bytes) falls in the bit field of a level."""
    words = digests.view("<u8").reshape(-1, 4)
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: n digests to the slots 0..n-1."""

    def __init__(self, fields: list[np.ndarray]):
        self.fields = fields
        ones = [int(f.sum()) for f in fields]
        self.starts = np.cumsum([0, *ones]).tolist()
        self.ranks = [np.cumsum(f, dtype=np.int32) - f for f in fields]

    @classmethod
    def build(cls, digests: np.ndarray) -> "PerfectHash":
        fields, left = [], digests
        while len(left):
            size = max(8, int(len(left) * SPREAD))
            at = _places(left, len(fields), size)
            hits = np.bincount(at, minlength=size)
            fields.append((hits == 1).astype(np.uint8))
            left = left[hits[at] > 1]
        return cls(fields)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest; -1 where no level has one (surely not a member)."""
        out, open_ = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, field in enumerate(self.fields):
            if not open_.size:
                break
            at = _places(digests[open_], level, field.size)
            hit = field[at] == 1
            out[open_[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def bucket_bytes(digests: np.ndarray, winner: np.ndarray, row: np.ndarray, size: np.ndarray):
    """The file of a bucket: head (JSON), bit fields, then the slots' digests, locators and sizes."""
    index = PerfectHash.build(digests)
    order = np.argsort(index.slots(digests))
    head = json.dumps({"n": len(digests), "fields": [int(f.size) for f in index.fields]}).encode()
    yield len(head).to_bytes(8, "little")
    yield head
    for f in index.fields:
        yield np.packbits(f, bitorder="little").tobytes()
    yield np.ascontiguousarray(digests[order]).tobytes()
    for column in (winner, row, size):
        yield column[order].astype("<i8").tobytes()


class Bucket:
    """A bucket's index as read from its file."""

    def __init__(self, folder: str, name: str):
        fs, path = open_folder(folder)
        with fs.open_input_file(f"{path}/{name}") as f:
            raw = f.read()
        at = 8 + int.from_bytes(raw[:8], "little")
        spec = json.loads(raw[8:at])
        fields = []
        for size in spec["fields"]:
            step = -(-size // 8)
            fields.append(np.unpackbits(np.frombuffer(raw, np.uint8, step, at), count=size, bitorder="little"))
            at += step
        self.index, n = PerfectHash(fields), spec["n"]
        self.digests = np.frombuffer(raw, np.uint8, 32 * n, at).reshape(n, 32)
        at += 32 * n
        self.winner, self.row, self.size = (np.frombuffer(raw, "<i8", n, at + 8 * n * k) for k in range(3))

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the slot holds the very digest."""
        slots = self.index.slots(digests)
        member = slots >= 0
        member[member] = (self.digests[slots[member]] == digests[member]).all(axis=1)
        return slots, member


def digest_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(_row, doc_id, digest) of every row, written once; ``row_col`` has the rows' numbers if they have been given."""

    def run(batches):
        for part in slices(batches):
            found = [hashlib.sha256(t.encode().translate(LOWER)).digest() for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array(found, pa.binary())], names=["_row", "doc_id", "digest"])

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("_row"))
    return materialize(map_slices(rows, run, "_row long, doc_id long, digest binary"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Each digest with its winner (the largest doc_id, of equal ones the last row) and count."""
    last = F.max(F.struct("doc_id", "_row"))
    return rows.groupBy("digest").agg(last.alias("w"), F.count(F.lit(1)).alias("size")).select("digest", "w.doc_id", "w._row", "size")


def _bucket(count: int):
    """Bucket of a digest by its first four bytes."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(count)).cast("int")


def _digest_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, folder: str) -> int:
    """Write the index of (digest, doc_id, _row, size) rows to ``folder``; the number of buckets."""
    distinct = materialize(history)
    n = distinct.count()
    count = max(-(-n // BUCKET_DIGESTS), min(MOST_SMALL, -(-n // LEAST_DIGESTS)), 1)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def write():
            whole = pa.Table.from_batches(held).combine_chunks()
            no = whole.column("bucket")[0].as_py()
            column = lambda name: whole.column(name).to_numpy()
            winner = whole.column("doc_id").fill_null(int(NO_ID)).to_numpy()
            digests = _digest_array(whole.column("digest"))
            put_file(folder, f"{no:08d}.mph", bucket_bytes(digests, winner, column("_row"), column("size")))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([no], pa.int32()), "n": pa.array([len(digests)], pa.int64())})

        for part in batches:
            at = part.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and b > a and held[-1].column("bucket")[0].as_py() != at[a]:
                    yield write()
                    held = []
                if b > a:
                    held.append(part.slice(a, b - a))
        if held:
            yield write()

    dealt = distinct.withColumn("bucket", _bucket(count)).repartition(count, "bucket").sortWithinPartitions("bucket")
    materialize(map_slices(dealt, run, "bucket int, n long"))
    return count


def look_up(rows: DataFrame, folder: str, count: int) -> DataFrame:
    """Rows with member, keep_id, keep_row and group_size of the index (null for nonmembers), written once."""

    def run(batches):
        bucket, at = None, None
        for part in slices(batches):
            digests, no = _digest_array(part.column("digest")), part.column("bucket").to_numpy()
            member = np.zeros(len(no), bool)
            keep, row, size = (np.zeros(len(no), np.int64) for _ in range(3))
            for b in np.unique(no).tolist():
                mine = np.flatnonzero(no == b)
                if b != at:
                    fs, path = open_folder(folder)
                    there = fs.get_file_info(f"{path}/{b:08d}.mph").is_file
                    bucket, at = Bucket(folder, f"{b:08d}.mph") if there else None, b
                if bucket is None:
                    continue
                slots, found = bucket.find(digests[mine])
                member[mine] = found
                mine, slots = mine[found], slots[found]
                keep[mine], row[mine], size[mine] = bucket.winner[slots], bucket.row[slots], bucket.size[slots]
            no_id = ~member | (keep == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("_row", "doc_id", "digest")), pa.array(member), pa.array(keep, mask=no_id), pa.array(row, mask=~member), pa.array(size, mask=~member)],
                names=["_row", "doc_id", "digest", "member", "keep_id", "keep_row", "group_size"],
            )

    dealt = rows.withColumn("bucket", _bucket(count)).hint("rebalance", "bucket").sortWithinPartitions("bucket")
    return materialize(map_slices(dealt, run, "_row long, doc_id long, digest binary, member boolean, keep_id long, keep_row long, group_size long"))


def dedup(docs: DataFrame, history: DataFrame | None = None, *, row_col: str | None = None, **columns) -> DataFrame:
    """(_row, doc_id, digest, member, keep_id, keep_row, group_size, kept) of every row of ``docs``.

    ``history``: documents seen before; what they hold is a repeat and goes (member, not kept), the rest is
    grouped among itself. None: the documents are their own history.
    """
    folder = work_path(docs.sparkSession, "mph")
    rows = digest_rows(docs, row_col=row_col, **columns)
    past = rows if history is None else digest_rows(history, **columns)
    found = look_up(rows, folder, build_index(_distinct(past), folder))
    own = F.lit(history is None)
    members = found.where("member").withColumn("kept", own & (F.col("_row") == F.col("keep_row")))
    new = found.where("not member").drop("keep_id", "keep_row", "group_size")
    groups = _distinct(new).select("digest", F.col("doc_id").alias("keep_id"), F.col("_row").alias("keep_row"), F.col("size").alias("group_size"))
    return members.unionByName(new.join(groups, "digest").withColumn("kept", F.col("_row") == F.col("keep_row")))


@without_leftovers
def one_of_each(docs: DataFrame, history: DataFrame | None = None, **columns) -> DataFrame:
    """The documents that ``dedup`` keeps."""
    numbered, row = numbered_once(docs, "_op10_row")
    stay = dedup(numbered, history, row_col=row, **columns).where("kept").select(F.col("_row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
