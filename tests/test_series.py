"""Fade, jump and outlier rules against constructed curves; as-of, regime and trend cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifecurve.operators import detectors, series
from lifecurve.operators.labels import horizon_label, true_pass
from lifecurve.operators.ordered import arrange

def plain_fade(values, limit=0.85, enough=3):
    """(last sticky crossing, recovered crossings) by looking at every later value."""
    last, recovered = None, 0
    for i, v in enumerate(values):
        if v < limit and (i == 0 or values[i - 1] >= limit):
            if sum(x > limit for x in values[i + 1 :]) < enough:
                last = i + 1
            else:
                recovered += 1
    return last, recovered


def drawn_fades():
    """Random walks over levels at, just around and far from the limit, of many lengths."""
    rnd = random.Random(11)
    return {f"walk{k}": [rnd.choice((0.61, 0.8499, 0.85, 0.8501, 0.97)) for _ in range(1 + k)] for k in range(45)}


FADE = {name: (values, *plain_fade(values)) for name, values in drawn_fades().items()}


def curves(spark, named):
    rows = [(name, i + 1, float(v)) for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, cycle int, retention double").repartition(3)


@pytest.fixture(params=["plain", "chunks of 25", "chunks of 5"])
def sizes(spark, request):
    if request.param != "plain":
        spark.conf.set("lifecurve.chunkRows", request.param.split()[-1])
    yield request.param
    spark.conf.unset("lifecurve.chunkRows")


def test_sticky_fade(spark, sizes):
    df = curves(spark, {k: v[0] for k, v in FADE.items()})
    out = series.sticky_fade(arrange(df, ["cell"], ["cycle"]), "cell").collect()
    got = {r.cell: (r.last_fade, r.n_recovered) for r in out}
    assert got == {k: (v[1], v[2]) for k, v in FADE.items()}
    assert {r.cell: r.final_retention for r in out} == {k: v[0][-1] for k, v in FADE.items()}


def test_horizon_labels(spark):
    rows = [("faded", 301, 400), ("faded", 300, 400), ("in_testing", None, 300), ("in_testing", None, 299), ("excluded", None, 500)]
    df = spark.createDataFrame(rows, "status string, fade int, n int")
    args = (F.col("status"), F.col("fade"), F.col("n"), 300)
    out = df.select("*", horizon_label(*args).alias("label"), true_pass(*args).alias("truth")).collect()
    assert [r.label for r in out] == ["pass", "bad", "pass", "censor", "excluded"]
    assert [r.truth for r in out] == [1.0, 1.0, 1.0, None, None]


def ramp(n, fall, levels=()):
    """A falling line; each (first, last, height) is added to the cycles from first to last."""
    return [1 - fall * c + sum(h for first, last, h in levels if first <= c <= last) for c in range(1, n + 1)]


def plain_kind(values, at, rule):
    """Class of the step at a cycle with enough neighbours: median distance of what follows to the line before."""
    x = np.arange(1, len(values) + 1)
    pre, post = slice(max(0, at - 1 - rule.pre_window), at - 1), slice(at - 1, at - 1 + rule.post_window)
    slope, level = np.polyfit(x[pre], np.array(values)[pre], 1)
    off = np.median(np.array(values)[post] - (slope * x[post] + level))
    return "sustained" if abs(off) >= rule.persist_min else "transient"


def step_cases(rule=detectors.JumpRule()):
    """One lasting shift for each height, place and fall: what the rule's limits say about it."""
    cases, n = {}, 73
    for height in (0.4, 0.031, 0.029, -0.029, -0.031, -0.25):
        for at in (rule.min_pre, rule.min_pre + 1, 37, n - rule.min_post + 1, n - rule.min_post + 2):
            before, after = at - 1, n - at + 1
            way = "up" if height > 0 else "down"
            kind = "edge_skip" if before < rule.min_pre or after < rule.min_post else "sustained"
            found = [(at, way, kind)] if abs(height) > rule.bump_min else []
            cases[f"shift {height} at {at}"] = (ramp(n, 0.0, [(at, n, height)]), found)
    for last in (40, 41, 43, 46):  # up and down again
        for height in (0.05, 0.3):
            values = ramp(n, 0.0005, [(40, last, height)])
            cases[f"bump {height} to {last}"] = (values, [(at, way, plain_kind(values, at, rule)) for at, way in ((40, "up"), (last + 1, "down"))])
    return cases


JUMPS = step_cases()


def test_jumps(spark, layout):
    df = curves(spark, {k: v[0] for k, v in JUMPS.items()})
    out = detectors.detect_jumps(arrange(df, ["cell"], ["cycle"]), "cycle", "retention").collect()
    got = {k: [] for k in JUMPS}
    for r in sorted(out, key=lambda r: r.jump_cycle):
        got[r.cell].append((r.jump_cycle, r.jump_direction, r.jump_class))
    assert got == {k: v[1] for k, v in JUMPS.items()}


def outlier_cases():
    """Lone spikes on lines of several falls, shifts that last, and spikes close to a boundary."""
    cases = {}
    for fall in (0.0, 0.0011, 0.004):
        for at in (20, 33, 61):
            for height in (0.3, -0.12):
                cases[f"spike {height} at {at}, fall {fall}"] = (ramp(66, fall, [(at, at, height)]), [at])
        cases[f"line, fall {fall}"] = (ramp(57, fall), [])
        cases[f"shift, fall {fall}"] = (ramp(88, fall, [(44, 88, 0.21)]), [])
        cases[f"two apart, fall {fall}"] = (ramp(90, fall, [(25, 25, 0.16), (66, 66, -0.19)]), [25, 66])
        cases[f"spike and shift, fall {fall}"] = (ramp(140, fall, [(30, 30, 0.22), (90, 140, -0.15)]), [30])
    cases["boundary"] = (ramp(66, 0.0011, [(34, 34, 0.3)]), [])
    return cases


OUTLIERS = outlier_cases()


def test_outliers(spark, layout):
    df = curves(spark, {k: v[0] for k, v in OUTLIERS.items()})
    cuts = spark.createDataFrame([("boundary", 33)], "cell string, boundary int")
    df = series.near_boundary(df, cuts, "cell", "cycle")
    out = detectors.detect_outliers(arrange(df, ["cell"], ["cycle"]), "cycle", "retention").collect()
    got = {k: [] for k in OUTLIERS}
    for r in sorted(out, key=lambda r: r.outlier_cycle):
        got[r.cell].append(r.outlier_cycle)
        assert r.n_outliers == len(OUTLIERS[r.cell][1])
    assert got == {k: v[1] for k, v in OUTLIERS.items()}


def test_row_order_and_scale_do_not_matter(spark):
    df = curves(spark, {k: v[0] for k, v in FADE.items()}).withColumnRenamed("retention", "cap")

    def run(d):
        o = series.with_retention(arrange(d, ["cell"], ["cycle"]), "cap", "cycle", baseline_cycle=1)
        return sorted(series.sticky_fade(o, "cell").select("cell", "last_fade", "n_recovered").collect())

    base = run(df)
    assert run(df.orderBy(F.rand(3)).repartition(7)) == base
    assert run(df.withColumn("cap", F.col("cap") * 4.0)) == base


@pytest.mark.parametrize("size", ["1000000", "2"])
def test_asof_and_running_min(spark, size):
    spark.conf.set("lifecurve.chunkRows", size)
    try:
        check_asof_and_running_min(spark)
    finally:
        spark.conf.unset("lifecurve.chunkRows")


def check_asof_and_running_min(spark):
    rows = [("a", 1, 1.0), ("a", 3, 0.8), ("a", 6, 0.9), ("b", 2, 0.5)]
    df = spark.createDataFrame(rows, "e string, c int, v double")
    fwd = {r.e: r for r in series.asof_forward(df, "e", "c", "v", [2, 4, 9]).collect()}
    assert (fwd["a"].value_at_n2, fwd["a"].cycle_at_n4, fwd["a"].value_at_n9) == (0.8, 6, None)
    low = {r.e: r for r in series.running_min_to(df, "e", "c", "v", [1, 9]).collect()}
    assert (low["a"].min_through_n1, low["a"].min_through_n9) == (1.0, 0.8)
    targets = spark.createDataFrame([("a", 5), ("b", 1), ("z", 3)], "e string, target int")
    back = {r.e: (r.value_at, r.cycle_at) for r in series.asof_backward(df, targets, "e", "c", "v", "target").collect()}
    assert back == {"a": (0.8, 3), "b": (None, None), "z": (None, None)}
    snap = spark.createDataFrame([("a", 4)], "e string, snapshot_cycle int")
    family = {r.e: r for r in series.retention_family(df, "e", "c", "v", [2, 9], snap, at=3).collect()}
    a = family["a"]
    assert (a.ret_c3, a.ret_last, a.ret_min, a.ret_n2, a.ret_n9, a.ret_snapshot) == (0.8, 0.9, 0.8, 0.8, None, 0.8)
    assert family["b"].ret_snapshot is None


def test_regimes(spark, layout):
    rows = [("a", 0, 267, 1.0), ("a", 1, 205, 1.5), ("b", 0, 10, 2.0), ("c", 0, None, 0.0), ("c", 1, 4, 1.0), ("c", 2, 5, None)]
    df = spark.createDataFrame(rows, "e string, pos int, n int, rate double")
    cuts = sorted((r.e, r.boundary) for r in series.regime_boundaries(df, "e", "pos", "n").collect())
    assert cuts == [("a", 267), ("c", 4)]
    pct = {r.e: r.max_rate_delta_pct for r in series.rate_delta_pct(df, "e", "rate").collect()}
    assert pct == {"a": 50.0, "b": None, "c": None}


def test_boundary_arrays(spark):
    df = spark.createDataFrame([([267, 205],), ([10],), ([],), ([3, None, 4, 9],)], "n array<int>")
    assert [r[0] for r in df.select(series.boundaries_of(F.col("n"))).collect()] == [[267], [], [], [3, 7]]


def test_rolling_trend_of_one_point(spark, layout):
    df = curves(spark, {"a": [1.0, 0.9, 0.8]})
    rows = {r.cycle: r for r in detectors.rolling_trend(arrange(df, ["cell"], ["cycle"]), "cycle", "retention").rows().collect()}
    assert (rows[1].pre_n, rows[2].pre_slope, rows[2].pre_intercept) == (0, 0.0, 1.0)
    assert rows[3].pre_slope == pytest.approx(-0.1)
