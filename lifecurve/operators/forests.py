"""Fitted forests as arrays, and the AUC after each of many moves of one column (permutation importance).

A row's place among a forest's thresholds decides its way, so a feature's value becomes a small code. A moved column
changes a row only in the trees that ask for it, and there only by the interval of the new code: per feature each such tree
is walked once per interval, and a move is a look-up of its codes.

1. Rows are numbered 0..n-1 and lie in blocks of ``BLOCK`` numbers. Per move and feature the codes go to the block of their
   new number, packed: two bytes of place and one or two of code per value.
2. A task has a block and a feature: it scores all moves of that feature there, with the votes added in the order of the
   trees, so the scores are those of the model to the last digit.
3. Scores go to ranges of scores per (repeat, feature), positives and negatives apart, 8 bytes each. A range counts its pairs;
   the ranges are added with the negatives below them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.ordered import arrange

BLOCK = 8192


@dataclass
class Tree:
    """Nodes as arrays; a leaf leads to itself. ``parts``: the shares of the two classes at each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parts: np.ndarray
    depth: int

    def leaves(self, codes: np.ndarray, moved: int = -1, code: int = 0) -> np.ndarray:
        """The leaf of each row of ``codes`` (features x rows), with ``code`` in place of the moved feature's."""
        at, rows = np.zeros(codes.shape[1], np.int32), np.arange(codes.shape[1])
        for _ in range(self.depth):
            asked = self.feature[at]
            seen = codes[asked, rows].astype(np.int32)
            if moved >= 0:
                seen[asked == moved] = code
            at = np.where(seen <= self.cut[at], self.left[at], self.right[at])
        return at


@dataclass
class Forest:
    """Thresholds of each feature in order, and the trees over codes."""

    cuts: list[np.ndarray]
    trees: list[Tree]

    @property
    def kind(self) -> np.dtype:
        return np.dtype("u1" if max(map(len, self.cuts), default=0) < 256 else "<u2")

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Features x rows: how many thresholds lie below each value."""
        return np.stack([np.searchsorted(cuts, x, side="left").astype(self.kind) for cuts, x in zip(self.cuts, columns, strict=True)])

    def moved_scores(self, codes: np.ndarray, feature: int, moved: np.ndarray) -> np.ndarray:
        """The score of each row for each row of ``moved`` (moves x rows), codes in place of the feature's own."""
        rows, most = codes.shape[1], len(self.cuts[feature])
        votes = [np.zeros(moved.shape), np.zeros(moved.shape)]
        for tree in self.trees:
            own = np.unique(tree.cut[tree.feature == feature])
            if not len(own):
                part = tree.parts[:, tree.leaves(codes)]
                votes[0] += part[0]
                votes[1] += part[1]
                continue
            found = np.stack([tree.parts[:, tree.leaves(codes, feature, c)] for c in (*own.tolist(), most)], axis=1)
            place = np.searchsorted(own, np.arange(most + 1), side="left")[moved] * rows + np.arange(rows)
            votes[0] += found[0].ravel().take(place)
            votes[1] += found[1].ravel().take(place)
        total = votes[0] + votes[1]
        return np.divide(votes[1], total, out=votes[1], where=total != 0)


def read_forest(model: PipelineModel, features: Sequence[str]) -> Forest | None:
    """The forest behind an assembler of exactly these features, for two classes; None for any other model."""
    stages = model.stages
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], RandomForestClassificationModel):
        return None
    if list(stages[0].getInputCols()) != list(features) or stages[1].numClasses != 2:
        return None
    listed: list[list[tuple]] = []
    for one in stages[1].trees:
        nodes: list[tuple] = []
        todo = [(one._java_obj.rootNode(), -1, 0)]
        while todo:
            node, parent, side = todo.pop()
            no = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = no
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                if split.getClass().getSimpleName() != "ContinuousSplit":
                    return None
                nodes.append([split.featureIndex(), split.threshold(), no, no, (0.0, 0.0), nodes[parent][5] + 1 if parent >= 0 else 0])
                todo += [(node.rightChild(), no, 1), (node.leftChild(), no, 0)]
            else:
                first, second = (float(x) for x in node.impurityStats().stats())
                total = first + second
                parts = (first / total, second / total) if total else (0.0, 0.0)
                nodes.append([-1, 0.0, no, no, parts, nodes[parent][5] + 1 if parent >= 0 else 0])
        listed.append(nodes)
    cuts = [np.unique([n[1] for nodes in listed for n in nodes if n[0] == f]).astype(float) for f in range(len(features))]
    trees = []
    for nodes in listed:
        feature, threshold, left, right, parts, depth = zip(*nodes, strict=True)
        cut = [int(np.searchsorted(cuts[f], t)) if f >= 0 else 0 for f, t in zip(feature, threshold, strict=True)]
        trees.append(Tree(np.array(feature, np.int32), np.array(cut, np.int32), np.array(left, np.int32), np.array(right, np.int32), np.array(parts).T.copy(), max(depth)))
    return Forest(cuts, trees) if max(map(len, cuts), default=0) < 1 << 16 else None


def moved_aucs(wide: DataFrame, forest: Forest, label: str, features: Sequence[str], maps: Sequence[tuple[int, str, int, int]], n: int, edges: Sequence[float] = (), *, block: int = BLOCK) -> DataFrame:
    """(_rep, _feature, auc) for each (repeat, feature, a, b) of ``maps``: row i's value goes to row (a i + b) mod n.

    ``wide`` has the rows once, numbered ``_no`` from 0. ``edges`` cut the scores into ranges; a range of one repeat and
    feature is one task's.
    """
    blocks, reps = -(-n // block), len(maps) // max(1, len(features))
    factor = {f: np.array([a for _, g, a, _ in maps if g == f], np.int64) for f in features}
    offset = {f: np.array([b for _, g, _, b in maps if g == f], np.int64) for f in features}
    kind, edges, names = forest.kind, np.array(edges, float), list(features)
    small = blocks * reps < 1 << 16

    def record(cells: list[tuple]) -> pa.RecordBatch:
        kinds = [("_block", pa.int64()), ("_feature", pa.int32()), ("_n", pa.binary()), ("_at", pa.binary()), ("_code", pa.binary()), ("_y", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*cells, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            no, y = batch.column("_no").to_numpy(), batch.column("_y").to_numpy()
            codes = forest.codes([batch.column(f"_x{k}").to_numpy() for k in range(len(names))])
            for home in np.unique(no // block).tolist():
                mine = no // block == home
                cells = (None, (no[mine] - home * block).astype("<u2").tobytes(), codes[:, mine].tobytes(), y[mine].tobytes())
                yield record([(home, f, *cells) for f in range(len(names))])
            for f, name in enumerate(names):
                to = (factor[name][:, None] * no + offset[name][:, None]) % n
                home = to // block
                key = home * reps + np.arange(reps)[:, None]
                order = np.argsort((key.astype(np.uint16) if small else key).ravel(), kind="stable")
                counts = np.bincount(key.ravel(), minlength=blocks * reps).reshape(blocks, reps).astype("<i4")
                at = (to - home * block).astype("<u2").ravel()[order]
                code = np.broadcast_to(codes[f], to.shape).ravel()[order]
                ends = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).tolist()
                yield record([(k, f, counts[k].tobytes(), at[i:j].tobytes(), code[i:j].tobytes(), None) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i])

    def score(key, table):
        home, f = (k.as_py() for k in key)
        rows = min(block, n - home * block)
        codes, y, moved = np.zeros((len(names), rows), kind), np.zeros(rows, np.int8), np.zeros((reps, rows), kind)
        for counts, at, code, said in zip(*[table.column(c).to_pylist() for c in ("_n", "_at", "_code", "_y")], strict=True):
            at = np.frombuffer(at, "<u2")
            if counts is None:
                codes[:, at] = np.frombuffer(code, kind).reshape(len(names), -1)
                y[at] = np.frombuffer(said, np.int8)
            else:
                moved[np.repeat(np.arange(reps), np.frombuffer(counts, "<i4")), at] = np.frombuffer(code, kind)
        found = forest.moved_scores(codes, f, moved)
        out = []
        for rep, scores in enumerate(found, 1):
            part = np.searchsorted(edges, scores, side="right")
            for k in range(len(edges) + 1):
                pos, neg = (scores[(part == k) & (y == v)].tobytes() for v in (1, 0))
                if pos or neg:
                    out.append((rep, f, k, pos, neg))
        kinds = [("_rep", pa.int32()), ("_feature", pa.int32()), ("_range", pa.int32()), ("_pos", pa.binary()), ("_neg", pa.binary())]
        return pa.Table.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=[k for k, _ in kinds])

    def count(key, table):
        pos, neg = (np.sort(np.frombuffer(b"".join(table.column(c).to_pylist()))) for c in ("_pos", "_neg"))
        won2 = int(np.searchsorted(neg, pos, side="left").sum() + np.searchsorted(neg, pos, side="right").sum())
        cells = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([v], pa.int64()) for v in (len(pos), len(neg), won2)]
        return pa.Table.from_arrays(cells, names=["_rep", "_feature", "_range", "_p", "_q", "_won2"])

    parts = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # 1: positive, 0: negative, 2: no label
    y = F.when(F.col(label) == 1, 1).when(F.col(label) != 1, 0).otherwise(2).cast("byte").alias("_y")
    rows = wide.select("_no", y, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(names)])
    rows = rows.repartition(max(1, min(parts, 4 * blocks)), F.floor(F.col("_no") / F.lit(block / 4)))
    dealt = rows.mapInArrow(deal, "_block long, _feature int, _n binary, _at binary, _code binary, _y binary").repartition(parts, "_block", "_feature")
    scored = dealt.groupBy("_block", "_feature").applyInArrow(score, "_rep int, _feature int, _range int, _pos binary, _neg binary")
    ranges = scored.repartition(parts, "_rep", "_feature", "_range").groupBy("_rep", "_feature", "_range")
    cells = ranges.applyInArrow(count, "_rep int, _feature int, _range int, _p long, _q long, _won2 long")
    o = arrange(cells, ["_rep", "_feature"], ["_range"], bound=len(edges) + 1).running(_upto=F.col("_q"))
    won2 = F.sum(F.col("_won2") + 2 * F.col("_p") * (F.col("_upto") - F.col("_q")))
    agg = o.rows().groupBy("_rep", "_feature").agg(won2.alias("_won2"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_feature") + 1)
    return agg.select("_rep", name.alias("_feature"), F.when(both, F.col("_won2") / 2 / (F.col("_p") * F.col("_q"))).alias("auc"))
