"""Token-id files of shuffled bit or byte planes (operator 1).

A shard file holds the ids of a run of documents one after another. The ids are cut into blocks of a fixed
number of ids; a block is transposed so that equal bits (or bytes) of all its ids lie together, and each
plane is compressed with zstandard. Planes that are all zero are left out. The file ends with its chunk
index: for each block the number of ids, where it starts, and the size of each plane, so a reader fetches
any block alone.

    file  = MAGIC, planes of block 0, planes of block 1, ..., index (JSON, zstandard), length of index (8 bytes)

Rows go to shards by ranges of doc_id; one shuffle carries ids, never texts. Odd input: null and empty texts
have the end id alone; a null doc_id comes before all others; equal doc_ids are ordered by their ids;
an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifecurve.llm.bpe import codec, default_path
from lifecurve.llm.common import map_slices, materialize, open_folder, put_file, slices, texts, work_path

MAGIC = b"LCPLANE1"
BLOCK_IDS = 1 << 16
SHARD_ROWS = 1 << 16
LEAST_ROWS = 1 << 11


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a block, lowest first: bits packed eight to a byte, or bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, unit: str) -> np.ndarray:
    """The ids of a block; None is a plane of zeros."""
    if unit == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def shard_bytes(ids: Iterator[np.ndarray], unit: str, block_ids: int, level: int) -> Iterator[bytes]:
    """The bytes of a shard file; holds one block at a time."""
    pack = zstandard.ZstdCompressor(level=level)
    index, at, held, size = [], len(MAGIC), [], 0
    yield MAGIC

    def block(part: np.ndarray) -> list[bytes]:
        nonlocal at
        done = [pack.compress(p) if any(p) else b"" for p in to_planes(part, unit)]
        index.append([int(part.size), at, [len(p) for p in done]])
        at += sum(map(len, done))
        return done

    for more in ids:
        held.append(more)
        size += more.size
        if size >= block_ids:
            whole = np.concatenate(held)
            for k in range(0, size - block_ids + 1, block_ids):
                yield from block(whole[k : k + block_ids])
            held = [whole[size - size % block_ids :]]
            size %= block_ids
    if size:
        yield from block(np.concatenate(held))
    tail = pack.compress(json.dumps({"unit": unit, "blocks": index}).encode())
    yield tail
    yield len(tail).to_bytes(8, "little")


class ShardReader:
    """Reads the blocks of a shard file by its chunk index."""

    def __init__(self, folder: str, name: str):
        fs, path = open_folder(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
        spec = json.loads(zstandard.decompress(self.file.read_at(tail, size - 8 - tail)))
        self.unit, self.blocks = spec["unit"], spec["blocks"]
        self.starts = np.cumsum([0, *(b[0] for b in self.blocks)]).tolist()
        self.unpack = zstandard.ZstdDecompressor()
        self.at, self.ids = -1, np.array([], "<u4")

    def block(self, k: int) -> np.ndarray:
        if k != self.at:
            n, at, sizes = self.blocks[k]
            raw, planes, done = self.file.read_at(sum(sizes), at), [], 0
            for s in sizes:
                planes.append(self.unpack.decompress(raw[done : done + s]) if s else None)
                done += s
            self.at, self.ids = k, from_planes(planes, n, self.unit)
        return self.ids

    def read(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the shard."""
        parts, k = [], bisect_right(self.starts, first) - 1
        while n > 0:
            ids = self.block(k)[first - self.starts[k] :][:n]
            parts.append(ids)
            first, n, k = first + ids.size, n - ids.size, k + 1
        return np.concatenate(parts) if parts else np.array([], "<u4")


def shard_bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Lower bounds of all shards but the first, from the ids alone."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("double").alias("id"))
    n = rows.count()
    shards = max(-(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if shards < 2:
        return []
    cuts = rows.approxQuantile("id", [k / shards for k in range(1, shards)], 0.1 / shards)
    return sorted({int(c) for c in cuts})


def write_ids(
    docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = 2, unit: str = "byte",
    block_ids: int = BLOCK_IDS, level: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode, write shard files below ``folder``/ids, and return the table of documents.

    Columns: shard, seq (place in the shard), doc_id, first (id in the shard), n_tokens. The table is
    written beside the shards as ``folder``/documents and read back.
    """
    spark, path = docs.sparkSession, path or default_path()
    bounds = shard_bounds(docs, id_col)

    def encode(batches):
        c = codec(path)
        for part in slices(batches):
            ids = [np.append(c.encode(t), end_id).astype(c.kind).tobytes() for t in texts(part, "text")]
            shard = [0 if d is None else bisect_right(bounds, d) for d in part.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column("doc_id"), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches):
        c = codec(path)
        rows: list[tuple] = []
        feed = ((r, i) for b in slices(batches) for r, i in zip(zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), strict=True), b.column("ids").to_pylist(), strict=True))
        row = next(feed, None)
        while row is not None:
            shard, first, seq = row[0][0], 0, 0

            def ids_of(shard=shard):
                nonlocal row, first, seq
                while row is not None and row[0][0] == shard:
                    ids = np.frombuffer(row[1], c.kind)
                    rows.append((shard, seq, row[0][1], first, ids.size))
                    first, seq = first + ids.size, seq + 1
                    yield ids
                    row = next(feed, None)

            put_file(f"{folder}/ids", f"{shard:08d}.planes", shard_bytes(ids_of(), unit, block_ids, level))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "seq", "doc_id", "first", "n_tokens"])
            rows.clear()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = map_slices(source, encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    written = map_slices(dealt, write, "shard int, seq long, doc_id long, first long, n_tokens long")
    written.write.mode("overwrite").parquet(f"{folder}/documents")
    return spark.read.schema(written.schema).parquet(f"{folder}/documents")


def read_ids(table: DataFrame, folder: str) -> DataFrame:
    """Fetch the ids of the rows of a table of documents from the shard files.

    Columns of the table, start (ids of all documents before) and ids_crc32.
    """
    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    placed = table.join(offsets, "shard").withColumn("start", F.col("first") + F.col("_offset")).drop("_offset")

    def fetch(batches):
        reader, at = None, None
        for part in slices(batches):
            crcs = []
            for shard, first, n in zip(*[part.column(k).to_pylist() for k in ("shard", "first", "n_tokens")], strict=True):
                if shard != at:
                    reader, at = ShardReader(f"{folder}/ids", f"{shard:08d}.planes"), shard
                crcs.append(zlib.crc32(reader.read(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(crcs, pa.int64())], names=[*part.schema.names, "ids_crc32"])

    shards = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = placed.repartition(shards, "shard").sortWithinPartitions("shard", "seq")
    return map_slices(runs, fetch, runs._jdf.schema().toDDL() + ", ids_crc32 long")


def ids_table(docs: DataFrame, **options) -> DataFrame:
    """Write all ids to a new folder of the working folder and read them back: one row per document."""
    folder = work_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, **options), folder).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "first")


__all__ = ["ShardReader", "from_planes", "ids_table", "materialize", "read_ids", "shard_bytes", "to_planes", "write_ids"]
