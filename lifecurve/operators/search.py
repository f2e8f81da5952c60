"""Nested parameter search: all fits of all folds and parameters advance together, one pass over the rows per round.

A fit is a job (seed, outer fold, inner fold, parameters). Folds are columns of one binned matrix, so a job only
decides which rows weigh; nothing is copied per job. The model is additive over binned features (a missing value has a
bin of its own) and is boosted component-wise: each round, each job gets the sums of gradients and curvatures per
(feature, bin), takes the feature with the greatest gain, and adds a damped Newton step to that feature's bins.

* The matrix is dealt to many partitions before it is written, as every pass reads it again. Features are counted in pairs:
  one sum per pair of codes gives the sums of both.
* A pass emits one row of sums per job and partition; they are summed by job and only the totals reach the driver,
  which holds the jobs' small models (jobs x rounds x bins numbers).
* Between rungs the parameters that score worse on the inner folds are stopped, per (seed, outer fold).
* The job without an inner fold is the refit on the whole outer-train slice; it scores the outer-test rows, so every
  row is tested once per seed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.learn import seeded_order
from lifecurve.operators.ordered import arrange, spread_evenly
from lifecurve.session import materialize

WHOLE = -1
#: Rounds after which parameters are compared, and the share that goes on.
RUNGS, KEPT = (8, 16), 0.5
ROUNDS, BINS = 24, 16
RATES, PENALTIES = (0.1, 0.3, 0.6), (1.0, 10.0)


@dataclass
class Job:
    """One fit: which rows it learns from, its parameters, and its model so far."""

    seed: int
    outer: int
    inner: int
    rate: float
    penalty: float
    start: float = 0.0
    terms: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def raw(self, columns: np.ndarray) -> np.ndarray:
        """The sum of all terms for codes by feature (features x rows); the terms of a feature are one table."""
        tables: dict[int, np.ndarray] = {}
        for feature, steps in self.terms:
            tables[feature] = tables[feature] + steps if feature in tables else steps
        out = np.full(columns.shape[1], self.start)
        for feature, steps in tables.items():
            out += steps.take(columns[feature])
        return out


@dataclass
class Found:
    """chosen: (seed, outer_fold, rate, penalty, inner_score); scores: (entity, label, seed, fold, proba)."""

    chosen: DataFrame
    scores: DataFrame


def bin_edges(df: DataFrame, features: str, bins: int = BINS) -> list[list[float]]:
    """Inner cuts of each feature at even shares of its measured values, for all features in one pass."""
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    shares = [k / bins for k in range(1, bins)]
    value = lambda i: F.get(F.col(features), i).cast("double")
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(value(i)), value(i)), shares, 10_000).alias(f"c{i}") for i in range(width)]) if width else None
    return [sorted(set(found.first()[i] or [])) for i in range(width)] if width else []


def fold_table(df: DataFrame, entity: str, label: str, seeds: Sequence[int], outer: int, inner: int, *, bound: int | None = None) -> DataFrame:
    """(entity, label, outer, inner): the outer fold per seed, and the inner fold per seed and outer fold (-1 where it is tested).

    Folds are stratified by the label; the order is that of ``stratified_folds`` for the seed.
    """
    copies = df.select(entity, label, F.posexplode(F.array(*map(F.lit, seeds))).alias("_s", "_seed"))
    copies = copies.withColumn("_h", seeded_order(F.col("_seed"), entity))
    o = arrange(copies, ["_s", label], ["_h", entity], bound=bound).position("_rank")
    outers = o.rows().select(entity, label, "_s", "_seed", F.pmod(F.col("_rank") - 1, F.lit(outer)).cast("int").alias("_o"))
    spread = outers.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    train = spread.where("_k <> _o").withColumn("_h", F.md5(F.concat_ws("/", "_seed", "_k", F.col(entity).cast("string"))))
    o = arrange(train, ["_s", "_k", label], ["_h", entity], bound=bound).position("_rank")
    inners = o.rows().select(entity, "_s", "_k", F.pmod(F.col("_rank") - 1, F.lit(inner)).cast("int").alias("_i"))
    tested = spread.where("_k = _o").select(entity, "_s", "_k", F.lit(-1).alias("_i"))
    listed = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))[c[-1]]
    per = outers.groupBy(entity).agg(F.first(label).alias(label), listed("_s", "_o").alias("outer"))
    return per.join(inners.unionByName(tested).groupBy(entity).agg(listed("_s", "_k", "_i").alias("inner")), entity)


def binned_matrix(df: DataFrame, entity: str, label: str, features: str, folds: DataFrame, bins: int = BINS, *, bound: int | None = None) -> DataFrame:
    """(entity, label, outer, inner, codes), written once: a byte per feature, the last bin of each for missing values."""
    edges = bin_edges(df, features, bins)
    rows = df.count() if bound is None else bound

    def code(batches):
        for batch in batches:
            rows = batch.column("_x").to_pylist()
            codes = np.full((len(rows), len(edges)), bins, np.uint8)
            wide = np.full((len(rows), len(edges)), np.nan)
            for k, row in enumerate(rows):
                values = [math.nan if v is None else v for v in (row or [])[: len(edges)]]
                wide[k, : len(values)] = values
            for j, cuts in enumerate(edges):
                there = ~np.isnan(wide[:, j])
                codes[there, j] = np.searchsorted(cuts, wide[there, j], side="left")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names[:-1], "codes"])

    both = df.select(entity, F.col(features).cast("array<double>").alias("_x")).join(folds, entity)
    both = both.select(entity, F.col(label).cast("int").alias(label), "outer", "inner", "_x")
    kind = dict(both.dtypes)[entity]
    both = spread_evenly(both, rows, entity)
    return materialize(both.mapInArrow(code, f"`{entity}` {kind}, `{label}` int, outer array<int>, inner array<int>, codes binary"))


class _Rows:
    """A batch of the matrix as arrays; ``columns`` has the codes by feature."""

    def __init__(self, batch: pa.RecordBatch, label: str):
        n = batch.num_rows
        self.y = batch.column(label).to_numpy().astype(float)
        fold = lambda c: np.array(batch.column(c).to_pylist(), np.int64).reshape(n, -1)
        self.outer, self.inner = fold("outer"), fold("inner")
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1)
        self.columns = np.ascontiguousarray(codes.T).astype(np.intp)

    def pairs(self, bins: int) -> np.ndarray:
        """One code for every two features; a last one without a partner stands with bin 0."""
        there = self.columns if len(self.columns) % 2 == 0 else np.vstack([self.columns, np.zeros_like(self.columns[:1])])
        return there[::2] * (bins + 1) + there[1::2]


def _fold_column(job: Job, seeds: Sequence[int], n_outer: int) -> int:
    """The column of ``inner`` with the job's fold of each row: -1 tested outside, else the inner fold."""
    return list(seeds).index(job.seed) * n_outer + job.outer


def _cells(pairs: Sequence[np.ndarray], weights: Sequence[np.ndarray], width: int, bins: int) -> np.ndarray:
    """Sums of each weight per (feature, bin) from sums per pair of codes."""
    size = bins + 1
    joint = np.array([[np.bincount(at, w, size * size) for at in pairs] for w in weights]).reshape(len(weights), -1, size, size)
    return np.stack([joint.sum(axis=3), joint.sum(axis=2)], axis=2).reshape(len(weights), -1, size)[:, :width]


def _sums(matrix: DataFrame, label: str, jobs: list[Job], seeds: Sequence[int], n_outer: int, bins: int, *, scored: bool = True, stepped: bool = True) -> dict[int, np.ndarray]:
    """Per job: [rows, positives, log loss and confusion counts of the inner fold (tp, fp, fn, n), then gradients and curvatures per bin].

    The counts of the inner fold are zero unless ``scored``; there are no gradients unless ``stepped``.
    """
    head = 7
    by_fold: dict[tuple[int, int], list[int]] = {}
    for no, job in enumerate(jobs):
        by_fold.setdefault((_fold_column(job, seeds, n_outer), job.inner), []).append(no)

    def run(batches):
        held: list[np.ndarray | None] = [None] * len(jobs)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, label)
            width, joint = len(rows.columns), rows.pairs(bins)
            for (column, inner), nos in by_fold.items():
                fold = rows.inner[:, column]
                learn, test = np.flatnonzero((fold >= 0) & (fold != inner)), np.flatnonzero((fold >= 0) & (fold == inner))
                at = [each[learn] for each in joint] if stepped else []
                for no in nos:
                    out = np.zeros(head + (2 * width * (bins + 1) if stepped else 0))
                    out[:2] = [len(learn), rows.y[learn].sum()]
                    p = 1 / (1 + np.exp(-jobs[no].raw(rows.columns))) if scored or stepped else None
                    if scored:
                        y, q = rows.y[test], np.clip(p[test], 1e-15, 1 - 1e-15)
                        says = q >= 0.5
                        out[2:head] = [-(y * np.log(q) + (1 - y) * np.log1p(-q)).sum(), (says * y).sum(), (says * (1 - y)).sum(), (~says * y).sum(), len(y)]
                    if stepped:
                        out[head:] = _cells(at, [(rows.y - p)[learn], (p * (1 - p))[learn]], width, bins).ravel()
                    held[no] = out if held[no] is None else held[no] + out
        if any(h is not None for h in held):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(jobs)), pa.int32()), pa.array([h.tolist() for h in held], pa.list_(pa.float64()))], names=["job", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sums = batch.column("sums")
            for k, no in enumerate(batch.column("job").to_pylist()):
                row = sums[k].values.to_numpy()
                held[no] = held[no] + row if no in held else row
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tolist() for h in held.values()], pa.list_(pa.float64()))], names=["job", "sums"])

    parts = matrix.mapInArrow(run, "job int, sums array<double>")
    totals = parts.repartition("job").mapInArrow(add, "job int, sums array<double>")
    return {r["job"]: np.array(r["sums"]) for r in totals.collect()}


def inner_score(sums: np.ndarray, optimize: str) -> float:
    """Score of one inner fold, greater is better."""
    _, _, loss, tp, fp, fn, n = sums[:7]
    if not n:
        return 0.0
    if optimize == "f1":
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    if optimize == "accuracy":
        return (n - fp - fn) / n
    if optimize == "log_loss":
        return -loss / n
    raise ValueError(f"unknown score {optimize!r}")


def _step(job: Job, sums: np.ndarray, bins: int) -> None:
    """Add the bin steps of the feature with the greatest gain (the first, if several have it)."""
    cells = sums[7:].reshape(2, -1, bins + 1)
    g, h = cells
    gains = (g * g / (h + job.penalty)).sum(axis=1)
    best = int(np.argmax(np.round(gains, 9)))
    job.terms.append((best, job.rate * g[best] / (h[best] + job.penalty)))


def nested_search(
    df: DataFrame, entity: str, label: str, features: str, *, seeds: Sequence[int] = (42,), outer: int = 5, inner: int = 5, rates: Sequence[float] = RATES,
    penalties: Sequence[float] = PENALTIES, rounds: int = ROUNDS, rungs: Sequence[int] = RUNGS, kept: float = KEPT, bins: int = BINS, optimize: str = "f1",
    bound: int | None = None,
) -> Found:
    """Search the whole grid on the inner folds of every outer-train slice, refit the best there, score the outer-test slice.

    ``df`` has one row per entity with a label 0 or 1 and an array of features (null or NaN where not measured).
    After the rounds named in ``rungs`` the share ``kept`` of the parameters still running goes on, by their mean
    score over the inner folds; ties go to the earlier point of the grid. An empty table gives no rows.
    """
    spark = df.sparkSession
    grid = list(product(rates, penalties))
    seeds = list(seeds)
    df = df.where(F.col(label).isNotNull())
    copies = None if bound is None else bound
    matrix = binned_matrix(df, entity, label, features, fold_table(df, entity, label, seeds, outer, inner, bound=copies), bins, bound=bound)
    jobs = [Job(s, k, i, r, p) for s in seeds for k in range(outer) for r, p in grid for i in (*range(inner), WHOLE)]
    scores: dict[tuple, float] = {}
    stops = sorted({r for r in rungs if 0 < r < rounds} | {rounds})
    for done in range(rounds + 1):
        if done == 0:
            first = _sums(matrix, label, jobs, seeds, outer, bins, scored=False, stepped=False)
            for no, at in first.items():
                n, positive = at[:2]
                jobs[no].start = math.log((positive + 0.5) / (n - positive + 0.5))
        sums = _sums(matrix, label, jobs, seeds, outer, bins, scored=done in stops, stepped=done < rounds)
        if not sums:
            break
        if done in stops:
            scores = _mean_scores(jobs, sums, optimize)
            running = _best(scores, seeds, outer, grid, kept if done < rounds else 0.0)
            pairs = [(job, sums[no]) for no, job in enumerate(jobs) if (job.rate, job.penalty) in running[job.seed, job.outer]]
            jobs, sums = [j for j, _ in pairs], {no: s for no, (_, s) in enumerate(pairs)}
        if done < rounds:
            for no, job in enumerate(jobs):
                _step(job, sums[no], bins)
    whole = [j for j in jobs if j.inner == WHOLE and scores]
    chosen = [(j.seed, j.outer, float(j.rate), float(j.penalty), float(scores[j.seed, j.outer, j.rate, j.penalty])) for j in whole]
    table = spark.createDataFrame(chosen, "seed long, outer_fold int, rate double, penalty double, inner_score double")
    return Found(table, _outer_scores(matrix, entity, label, whole, seeds, outer))


def _mean_scores(jobs: list[Job], sums: dict[int, np.ndarray], optimize: str) -> dict[tuple, float]:
    each: dict[tuple, list[float]] = {}
    for no, job in enumerate(jobs):
        if job.inner != WHOLE:
            each.setdefault((job.seed, job.outer, job.rate, job.penalty), []).append(inner_score(sums[no], optimize))
    return {k: sum(v) / len(v) for k, v in each.items()}


def _best(scores: dict[tuple, float], seeds, outer: int, grid, share: float) -> dict[tuple, set]:
    """The parameters that go on per (seed, outer fold); at least one does."""
    out = {}
    for s in seeds:
        for k in range(outer):
            there = [p for p in grid if (s, k, *p) in scores]
            order = sorted(range(len(there)), key=lambda i: (-round(scores[s, k, *there[i]], 12), i))
            out[s, k] = {there[i] for i in order[: max(1, math.ceil(len(there) * share))]}
    return out


def _outer_scores(matrix: DataFrame, entity: str, label: str, whole: list[Job], seeds: list[int], n_outer: int) -> DataFrame:
    """One row per entity and seed, scored by the fit that has not seen it."""
    kind = dict(matrix.dtypes)[entity]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, label)
            for job in whole:
                there = np.flatnonzero(rows.inner[:, _fold_column(job, seeds, n_outer)] < 0)
                p = 1 / (1 + np.exp(-job.raw(rows.columns[:, there])))
                take = lambda c: batch.column(c).take(pa.array(there))
                n = len(there)
                yield pa.RecordBatch.from_arrays([take(entity), take(label), pa.array([job.seed] * n, pa.int64()), pa.array([job.outer] * n, pa.int32()), pa.array(p)], names=[entity, label, "seed", "fold", "proba"])

    return matrix.mapInArrow(run, f"`{entity}` {kind}, `{label}` int, seed long, fold int, proba double")
