"""A Merkle manifest of a table with a proof for every row, by pointer jumping (operator 12).

Leaves are digests of rows. Per group (``lang``) they ascend by id, and runs of two become the digest of their hex
texts, level by level; a lone last node is hashed alone. What remains is the group's subroot; subroots ordered by group
(null first, bytewise) give the root likewise.

* Building: ``2 ** BLOCK_LEVELS`` consecutive nodes of a tree are one block. A task hashes the levels inside a block
  and emits each node with its sibling; the tops of blocks are the next round's lowest level. Trees
  are drawn out to one height, so the leaves of all groups are equally far from the root.
* Proofs: a node holds the segment of siblings on the way to its ancestor, at first its own sibling. Round j joins the
  nodes whose height divides by 2^j with the ancestors that their segments reach, and concatenates the segments: the
  distance doubles, and only leaves are left in the end, with their way to the root.
* Checks: every row folds its digest, taken anew, with its siblings, and compares with the root.

Every round is written to the working folder. A join's keys are the ancestors, which have 2^2^(j-1) nodes each: the fewer
the ancestors, the smaller their table, so a large group is no hot key.

Odd input: a null group is a group of its own, null ids come first, rows equal in all leaf columns are leaves of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, slices
from lifecurve.llm.ranges import numbered

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10
TAMPER_EVERY = 7
_CARRIED = "struct<doc_id: long, digest: binary, changed: binary, levels: int>"
_NODE = f"h int, g long, i long, digest binary, segment array<binary>, leaf {_CARRIED}"


def said(column: Column) -> Column:
    """A value as it enters a digest: its UTF-8 byte count, a colon and itself; null is a dash."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """Binary digest of a row's values."""
    return F.unhex(F.sha2(F.concat(*map(said, columns)), 256))


def tampered(doc: Column, every: int = TAMPER_EVERY) -> Column:
    """Rows that are altered to try the check: the CRC-32 of the decimal id divides by ``every``."""
    return F.coalesce(F.crc32(doc.cast("string")) % every == 0, F.lit(False))


def levels_of(n: Column) -> Column:
    """Rounds of halving until one of n nodes remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def H(*digests: bytes) -> bytes:
    """Digest of digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaves(docs: DataFrame, columns=COLUMNS, group: str = "lang", id_col: str = "doc_id", altered: str = "n_chars") -> DataFrame:
    """(doc_id, lang, digest, changed): changed is the digest of the altered row where it is tampered with."""
    doc = F.col(id_col)
    plain = [F.col(c) for c in columns]
    other = [F.col(c).cast("long") + 1 if c == altered else F.col(c) for c in columns]
    changed = F.when(tampered(doc) & F.col(altered).isNotNull(), leaf_digest(other)) if altered in columns else F.lit(None).cast("binary")
    return docs.select(doc.cast("long").alias("doc_id"), F.col(group).cast("string").alias("lang"), leaf_digest(plain).alias("digest"), changed.alias("changed"))


def _block(nodes: list[dict], g: int, block: int, h0: int, levels: int, top: int, in_block: int) -> Iterator[tuple]:
    """All nodes above and in one block of sorted nodes: (h, g, i, digest, segment, leaf); the top of the block has no segment.

    ``levels``: height of this tree's own top; from there up to ``top`` the node is drawn out without a sibling.
    """
    row, first = [(n["digest"], n["leaf"]) for n in nodes], block << in_block
    end = min(h0 + in_block, top)
    for h in range(h0, end):
        real = h < levels
        for k, (digest, leaf) in enumerate(row):
            sibling = row[k ^ 1][0] if real and k ^ 1 < len(row) else None
            yield h, g, first + k, digest, [sibling], leaf
        if real:
            row = [(H(*(d for d, _ in row[k : k + 2])), None) for k in range(0, len(row), 2)]
            first >>= 1
    for k, (digest, leaf) in enumerate(row):
        yield end, g, first + k, digest, None, leaf


def _levels_up(lowest: DataFrame, h0: int, top: int, in_block: int) -> DataFrame:
    """One round of building: ``lowest`` (g, i, digest, levels, leaf) at height h0 to nodes of heights h0 to h0 + in_block."""
    member = F.struct("i", "digest", "leaf")
    blocks = lowest.groupBy("g", F.shiftright("i", in_block).alias("block"), "levels").agg(F.sort_array(F.collect_list(member)).alias("nodes"))

    def run(batches):
        for part in slices(batches):
            for r in part.to_pylist():
                cols = list(zip(*_block(r["nodes"], r["g"], r["block"], h0, r["levels"], top, in_block), strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.struct([("doc_id", pa.int64()), ("digest", pa.binary()), ("changed", pa.binary()), ("levels", pa.int32())])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "g", "i", "digest", "segment", "leaf"])

    return materialize(map_slices(blocks, run, _NODE))


def _forest(lowest: DataFrame, h0: int, top: int, in_block: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with segments, tops) of all trees of ``lowest`` (g, i, digest, levels, leaf), drawn out from h0 to ``top``."""
    nodes, levels = [], lowest.groupBy("g").agg(F.first("levels").alias("levels"))
    while True:
        made = _levels_up(lowest, h0, top, in_block)
        nodes.append(made.where("segment is not null"))
        h0 = min(h0 + in_block, top)
        tops = made.where("segment is null")
        if h0 >= top:
            break
        lowest = tops.join(levels, "g").select("g", "i", "digest", "levels", "leaf")
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.union(more)
    return whole, tops


def _jump(nodes: DataFrame, group_top: int, top: int) -> DataFrame:
    """Segments from the leaves to the root, by doubling. Nodes below ``group_top`` are (g, i) of a group's tree, above (0, i)."""
    step, now = 1, nodes.select("h", "g", "i", "segment", "leaf")
    while step < top:
        reach = F.col("h") + step
        inside, below = reach < group_top, F.col("h") < group_top
        up = F.shiftright("i", step)
        crossing = F.expr(f"shiftright(g, greatest(h + {step} - {group_top}, 0))")
        low = now.where(F.col("h") % (2 * step) == 0).withColumns(
            {"to_h": reach, "to_g": F.when(inside, F.col("g")).otherwise(0).cast("long"), "to_i": F.when(inside | ~below, up).otherwise(crossing)}
        )
        high = now.where(F.col("h") % (2 * step) == step).select(F.col("h").alias("to_h"), F.col("g").alias("to_g"), F.col("i").alias("to_i"), F.col("segment").alias("further"))
        joined = low.join(high, ["to_h", "to_g", "to_i"], "left")
        longer = F.concat("segment", F.coalesce("further", F.array().cast("array<binary>")))
        now, step = materialize(joined.select("h", "g", "i", longer.alias("segment"), "leaf")), 2 * step
    return now.where("h = 0")


def fold(digest: bytes, siblings: list[bytes | None], i: int, levels: int, group_top: int, rank: int) -> bytes:
    """The root from a leaf and its siblings: place i in a tree of ``levels``, whose subroot is the rank-th."""
    for h, other in enumerate(siblings):
        if levels <= h < group_top:
            continue
        odd = (i >> h if h < group_top else rank >> (h - group_top)) & 1
        digest = H(digest) if other is None else H(other, digest) if odd else H(digest, other)
    return digest


def manifest(docs: DataFrame, *, block_levels: int = BLOCK_LEVELS, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see ``leaves`` for options.

    leaf, subroot, root and proof are those of the rows as they are; folded_root starts from the altered row, if any.
    """
    rows = materialize(leaves(docs, **options))
    facts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", levels_of(F.col("n")).alias("levels")))
    many, tallest = facts.agg(F.count(F.lit(1)), F.max("levels")).first()
    if not many:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    upper = (many - 1).bit_length()
    top = tallest + upper
    ranks = numbered(facts, [], ["lang"], "g").select(F.struct("lang").alias("_lang"), "g", "levels")
    placed = numbered(rows, ["lang"], ["doc_id", "digest"], "i").withColumn("_lang", F.struct("lang"))
    lowest = materialize(placed.join(ranks, "_lang").select("g", "i", "digest", "levels", F.struct("doc_id", "digest", "changed", "levels").alias("leaf")))
    none = F.lit(None).cast(_CARRIED)
    if tallest:
        nodes, tops = _forest(lowest, 0, tallest, block_levels)
        tops = tops.select("g", "digest", "leaf")
    else:  # every row is a group of its own
        nodes, tops = None, lowest.select("g", "digest", "leaf")
    tops = materialize(tops)
    above = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "digest", F.lit(top).alias("levels"), F.col("leaf") if not tallest else none.alias("leaf"))
    if upper:
        higher, last = _forest(above, tallest, top, block_levels)
        nodes = higher if nodes is None else nodes.union(higher)
        root = last.first()["digest"]
    else:
        root = above.first()["digest"]
    if nodes is None:  # a single row is its own root
        ways = lowest.select("g", "i", F.array().cast("array<binary>").alias("segment"), "leaf")
    else:
        ways = _jump(nodes, tallest, top)
    if nodes is not None and not tallest:  # leaves are subroots: their place is their group's
        ways = ways.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "segment", "leaf")
    subroots = tops.select("g", F.col("digest").alias("subroot"))
    whole = ways.join(subroots, "g").select("g", "i", "segment", "leaf.*", "subroot")
    root_hex = root.hex()

    def check(batches):
        for part in slices(batches):
            out: dict[str, list] = {k: [] for k in ("leaf", "subroot", "proof_sha256", "folded_root")}
            for r in part.drop_columns(["doc_id"]).to_pylist():
                out["leaf"].append(r["digest"].hex())
                out["subroot"].append(r["subroot"].hex())
                out["proof_sha256"].append(H(*(s for s in r["segment"] if s is not None)).hex())
                out["folded_root"].append(fold(r["changed"] or r["digest"], r["segment"], r["i"], r["levels"], tallest, r["g"]).hex())
            n = part.num_rows
            good = [f == root_hex for f in out["folded_root"]]
            cells = [part.column("doc_id"), *(pa.array(out[k], pa.string()) for k in ("leaf", "subroot")), pa.array([root_hex] * n), *(pa.array(out[k], pa.string()) for k in ("proof_sha256", "folded_root")), pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return map_slices(whole, check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


__all__ = ["H", "fold", "leaf_digest", "leaves", "levels_of", "manifest", "said", "tampered"]
