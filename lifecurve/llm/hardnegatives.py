"""Hard negatives by angular triangle filtering (operator 13).

Vectors become integers, floor(256 x); scores are their inner products. Each row stores its norm and its angles to
``REFERENCES`` reference directions (fitted on a bounded sample of ``SAMPLE_ROWS`` rows, all rows are indexed). For two
rows the angle between them lies between the largest difference and the smallest sum of their angles to a reference, so
the cosines of these, times the norms, widened for rounding, bound the score.

1. Rows are ordered by (label, nearest reference, angle to it) and cut into blocks of ``BLOCK_ROWS`` (fewer, if vectors are long). A small table holds
   each block's range of labels, norms and angles. Anchors form groups of neighbours of this order.
2. Positives: anchors are scored in their own block first, which gives the least score to beat; a (group, block) pair is
   looked at only if labels meet and the bound of the ranges reaches that score, and within it only rows whose own bound does.
3. Negatives: a positive's score s gives the window from 50 s to 95 s in hundredths. Blocks and rows whose score bounds do
   not meet an anchor's windows are passed over; the others get integer scores, and the best of each window are merged.

Anchors are a stated query set (ids divisible by ``ANCHOR_EVERY``), held in blocks against blocks of all rows. Nothing is cut
off: a bound only spares rows that cannot be among the result, which equals brute force.

Odd input: rows with a null label, a null vector, or a null or non-finite component take no part; a row without an id is
no anchor, and comes last among ties; shorter vectors count as filled up with zeros; rows with the same id are rows of
their own; scores beyond 64 bits are computed exactly and returned as the nearest 64-bit integer; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, slices
from lifecurve.llm.ranges import numbered

REFERENCES = 16
SAMPLE_ROWS = 2048
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 19
GROUP_BLOCKS = 4
#: Anchors of a group that are held against a block together.
ANCHORS_AT_ONCE = 256
ANCHOR_EVERY, POISON_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative's lies.
LEAST_PART, MOST_PART = 50, 95
#: Radians by which angles are widened: an arc cosine in double precision is off by less.
SLACK = 4e-7
NO_ID = (1 << 63) - 1


def matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of numbers, filled up with zeros."""
    ends = vectors.offsets.to_numpy()
    sizes = np.diff(ends)
    wide = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), wide))
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def integers(whole: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component; int64, or Python integers where those are too small."""
    if whole.size and np.abs(whole).max() >= 2.0**54:
        return np.array([[math.floor(x * 256) if abs(x) < 2.0**60 else int(x) * 256 for x in row] for row in whole.tolist()], object).reshape(whole.shape)
    return np.floor(whole * 256.0).astype(np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, as the nearest 64-bit integers."""
    wide = max(left.shape[1], right.shape[1])
    left, right = (x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (left, right))
    if left.dtype != object and right.dtype != object:
        top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, wide)
        if top < 2.0**53:  # every partial sum is a whole number that a double holds
            return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
        if top < 2.0**63:
            return left @ right.T
    found = left.astype(object) @ right.astype(object).T
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths, without overflow of large components."""
    real = rows.astype(np.float64)
    top = np.abs(real).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return np.sqrt(((real / safe[:, None]) ** 2).sum(axis=1)) * top


def angles(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Radians between each row and each unit direction; a right angle for a row of zeros, whose scores are 0 anyway."""
    real, long_ = rows.astype(np.float64), norms(rows)
    unit = real / np.where(long_ > 0, long_, 1.0)[:, None]
    wide = max(unit.shape[1], directions.shape[1])
    fill = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    return np.arccos(np.clip(fill(unit) @ fill(directions).T, -1.0, 1.0))


def score_bounds(least: np.ndarray, most: np.ndarray, low_norms, high_norms) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a score from those of the angle and of the product of norms, safe against rounding."""
    low_cos, high_cos = np.cos(np.minimum(most + SLACK, np.pi)), np.cos(np.maximum(least - SLACK, 0.0))
    below = np.where(low_cos < 0, low_cos * high_norms, low_cos * low_norms)
    above = np.where(high_cos > 0, high_cos * high_norms, high_cos * low_norms)
    spare = 1 + 1e-9 * np.abs(high_norms)
    return below - spare, above + spare


def angle_bounds(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle between all rows of two tables of angles to the same references."""
    least = np.zeros((len(left), len(right)))
    most = np.full(least.shape, np.pi)
    for k in range(left.shape[1]):
        a, b = left[:, k, None], right[None, :, k]
        np.maximum(least, np.abs(a - b), out=least)
        both = a + b
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    return least, most


def directions(rows: DataFrame, count: int = REFERENCES, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit vectors of rows far apart: the first of a bounded sample, then always the one furthest from those taken."""
    order = [F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector")]
    sample = rows.select("vec_id", "vector").orderBy(*order).limit(sample_rows).collect()
    taken = integers(matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.float64()))))
    long_ = norms(taken)
    unit = taken.astype(np.float64)[long_ > 0] / long_[long_ > 0][:, None]
    if not len(unit):
        return np.zeros((0, max(1, taken.shape[1])))
    picked, nearest = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    return unit[picked]


def taking_part(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; ``label`` replaces the column as an expression."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # a NaN is greater than all
    rows = table.where(fine).where(finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), vector.alias("vector"))


def poisoned(id_col: str = "vec_id", label_col: str = "label", every: int = POISON_EVERY, labels: int = LABELS) -> Column:
    """The label, moved on by one where the id divides by ``every``."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))


def index(rows: DataFrame, at: np.ndarray) -> DataFrame:
    """Written rows with n (their place in the order), norm and angles."""

    def run(batches):
        for part in slices(batches):
            real = integers(matrix(part.column("vector")))
            to = angles(real, at) if len(at) else np.full((len(real), 1), np.pi / 2)  # a right angle bounds nothing
            near = to.argmin(axis=1)
            more = [pa.array(norms(real)), pa.array(to.tolist(), pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(to[np.arange(len(to)), near])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "label", "vector")), *more], names=["vec_id", "label", "vector", "norm", "angles", "cell", "to_cell"])

    found = materialize(map_slices(rows, run, "vec_id long, label long, vector array<double>, norm double, angles array<double>, cell int, to_cell double"))
    return materialize(numbered(found, [], ["label", "cell", "to_cell", "vec_id"], "n").drop("cell", "to_cell"))


def _ranges(rows: DataFrame, name: str, count: int, *more: Column) -> DataFrame:
    """Ranges of label, norm and angles of each block or group, and what else is asked for."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("label", "norm") for f, n in ((F.min, "low"), (F.max, "high"))]
    spans = [F.array(*[f(F.col("angles")[k]) for k in range(count)]).alias(f"{n}_angles") for f, n in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy(name).agg(*ends, *spans, *more)


def _bound(sign: int) -> Column:
    """Greatest (sign 1) or least (-1) score between a group (g) and a block (b), from their ranges, safe against rounding."""
    spans = F.arrays_zip(F.col("g.low_angles").alias("gl"), F.col("g.high_angles").alias("gh"), F.col("b.low_angles").alias("bl"), F.col("b.high_angles").alias("bh"))
    if sign > 0:
        angle = F.array_max(F.transform(spans, lambda s: F.greatest(s["gl"] - s["bh"], s["bl"] - s["gh"], F.lit(0.0)))) - SLACK
        cos = F.cos(F.greatest(angle, F.lit(0.0)))
    else:
        angle = F.array_min(F.transform(spans, lambda s: F.least(s["gh"] + s["bh"], F.lit(2 * math.pi) - s["gl"] - s["bl"]))) + SLACK
        cos = F.cos(F.least(angle, F.lit(math.pi)))
    low, high = F.col("g.low_norm") * F.col("b.low_norm"), F.col("g.high_norm") * F.col("b.high_norm")
    grown = F.when(cos * sign > 0, high).otherwise(low)
    return cos * grown + sign * (1 + 1e-9 * F.abs(high))


def _packed(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row per block or group, whose rows are of bounded number."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", *fields))).alias(name))


@dataclass
class _Rows:
    """Rows of a block, or anchors, as arrays."""

    n: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    more: dict[str, list]

    @classmethod
    def of(cls, said: pa.StructArray, at: slice = slice(None), extra: tuple[str, ...] = ()) -> _Rows:
        said = said[at]
        pick = lambda c: pc.struct_field(said, c)
        ids = pick("vec_id").fill_null(NO_ID).to_numpy()
        numbers = [pick(c).to_numpy() for c in ("n", "label", "norm")]
        return cls(numbers[0], ids, numbers[1], integers(matrix(pick("vector"))), numbers[2], matrix(pick("angles")), {c: pick(c).to_pylist() for c in extra})

    def bounds(self, block: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores with all rows of a block."""
        least, most = angle_bounds(self.angles, block.angles)
        both = self.norms[:, None] * block.norms[None, :]
        return score_bounds(least, most, both, both)

    def scores(self, block: _Rows, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores with the rows at these places): the rows whose window some anchor's overlaps."""
        at = np.flatnonzero(open_.any(axis=0))
        return at, products(self.vectors, block.vectors[at])


def _best(block: _Rows, at: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """The places in ``at`` of the first ``most`` by score downwards, id, n."""
    if scores.size > most:
        near = np.flatnonzero(scores >= np.partition(scores, scores.size - most)[scores.size - most])
    else:
        near = np.arange(scores.size)
    return near[np.lexsort((block.n[at[near]], block.ids[at[near]], -scores[near]))[:most]]


def _find(pairs: DataFrame, judge, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (tuples in the order of the schema) that ``judge(anchors, block)`` finds for every group and block of the pairs."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                group, block = (batch.column(c)[k].values for c in ("anchors", "rows"))
                block = _Rows.of(block)
                for at in range(0, len(group), ANCHORS_AT_ONCE):
                    out = list(judge(_Rows.of(group, slice(at, at + ANCHORS_AT_ONCE), extra), block))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return map_slices(pairs, run, schema)


def _top(rows: DataFrame, by: list[str], score: str, most: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col("vec_id").asc(), F.col("n").asc())
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def hard_negatives(
    rows: DataFrame, *, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least_part: int = LEAST_PART,
    most_part: int = MOST_PART, references: int = REFERENCES, block_rows: int | None = None, group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, vector)."""
    rows = materialize(rows)
    at = directions(rows, references)
    if block_rows is None:  # so that a block's vectors fit a few megabytes
        width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
        block_rows = max(64, min(BLOCK_ROWS, BLOCK_CELLS // width))
    indexed = index(rows, at).withColumn("block", F.floor(F.col("n") / block_rows).cast("long"))
    count = max(1, len(at))
    blocks = materialize(_ranges(indexed, "block", count))
    n_blocks = blocks.count()
    fields = ["vec_id", "label", "vector", "norm", "angles"]
    packed = materialize(_packed(indexed, "block", fields, "rows"))
    anchors = indexed.where(F.col("vec_id") % anchor_every == 0).withColumn("group", F.floor(F.col("block") / group_blocks).cast("long"))

    def against(facts: DataFrame, wanted, extra: list[str]) -> DataFrame:
        """Pairs (anchors of a group, rows of a block) that the ranges do not rule out."""
        more = [F.min(c).alias(c) if c != "most" else F.max(c).alias(c) for c in extra]
        spans = _ranges(facts, "group", count, *more)
        spread = spans.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))) if n_blocks else spans.withColumn("block", F.lit(0).cast("long"))
        near = spread.alias("g").join(blocks.alias("b"), F.col("g.block") == F.col("b.block")).where(wanted).select("g.group", "b.block")
        held = materialize(_packed(facts, "group", [*fields, *extra], "anchors"))
        return near.join(held, "group").join(packed, "block").select("anchors", "rows")

    # The score that a positive must reach: the last of enough rows of the label in the anchor's own block.
    def nearby(some, block):
        same = (some.labels[:, None] == block.labels) & (some.n[:, None] != block.n)
        at, scores = some.scores(block, same)
        for k in range(len(some.n)):
            own = scores[k][same[k, at]]
            if own.size >= positives:
                yield int(some.n[k]), int(np.partition(own, own.size - positives)[own.size - positives])

    own = _packed(anchors, "block", fields, "anchors").join(packed, "block").select("anchors", "rows")
    floors = _find(own, nearby, "n long, floor long")
    none = F.lit(-(1 << 63)).cast("long")
    first = materialize(anchors.join(floors, "n", "left").withColumn("floor", F.coalesce("floor", none)))
    meet = (F.col("b.low_label") <= F.col("g.high_label")) & (F.col("g.low_label") <= F.col("b.high_label"))

    def best_positives(some, block):
        _, above = some.bounds(block)
        open_ = (some.labels[:, None] == block.labels) & (some.n[:, None] != block.n) & (above >= np.array(some.more["floor"], float)[:, None])
        at, scores = some.scores(block, open_)
        for k in range(len(some.n)):
            mine = np.flatnonzero(open_[k, at])
            for j in mine[_best(block, at[mine], scores[k][mine], positives)]:
                yield int(some.n[k]), int(block.ids[at[j]]), int(block.n[at[j]]), int(scores[k][j])

    found = _find(against(first, meet & (_bound(1) >= F.col("g.floor")), ["floor"]), best_positives, "anchor long, vec_id long, n long, score long", ("floor",))
    chosen = _top(found, ["anchor"], "score", positives, "place")
    window = lambda part, up: (F.floor if up else F.ceil)(F.col("score").cast("decimal(20,0)") * part / 100)
    wanted = F.struct("place", "vec_id", "n", "score", window(least_part, False).cast("long").alias("low"), window(most_part, True).cast("long").alias("high"))
    goals = chosen.where("score >= 0").groupBy(F.col("anchor").alias("n")).agg(F.sort_array(F.collect_list(wanted)).alias("goals"))
    second = materialize(anchors.join(goals, "n").withColumn("least", F.array_min("goals.low")).withColumn("most", F.array_max("goals.high")))
    differ = (F.col("b.low_label") != F.col("b.high_label")) | (F.col("g.low_label") != F.col("g.high_label")) | (F.col("b.low_label") != F.col("g.low_label"))
    fields = [*fields, "goals"]

    def best_negatives(some, block):
        below, above = some.bounds(block)
        least, most = (np.array(some.more[c], float)[:, None] for c in ("least", "most"))
        open_ = (some.labels[:, None] != block.labels) & (above >= least) & (below <= most)
        at, scores = some.scores(block, open_)
        for k in range(len(some.n)):
            mine = np.flatnonzero(open_[k, at])
            own = scores[k][mine]
            for goal in some.more["goals"][k]:
                inside = np.flatnonzero((own >= goal["low"]) & (own <= goal["high"]))
                for j in inside[_best(block, at[mine[inside]], own[inside], negatives)] if inside.size else ():
                    row = at[mine[j]]
                    yield int(some.n[k]), int(some.ids[k]), goal["place"], NO_ID if goal["vec_id"] is None else goal["vec_id"], goal["score"], int(block.ids[row]), int(block.n[row]), int(own[j])

    overlap = (_bound(1) >= F.col("g.least")) & (_bound(-1) <= F.col("g.most"))
    mined = _find(against(second, differ & overlap, ["least", "most"]), best_negatives, "anchor long, anchor_id long, place long, positive_id long, positive_score long, vec_id long, n long, score long", ("least", "most", "goals"))
    ranked = _top(mined, ["anchor", "place"], "score", negatives, "rank")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked.select(
        "anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mine(table: DataFrame, **options) -> DataFrame:
    """``hard_negatives`` of a table of embeddings whose labels are poisoned where the id divides by 7."""
    return hard_negatives(taking_part(table, label=poisoned()), **options)


__all__ = ["angle_bounds", "directions", "hard_negatives", "integers", "matrix", "mine", "poisoned", "products", "score_bounds", "taking_part"]
