"""Integrals, resampling, peaks and fits on analytic curves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifecurve.operators import curves
from lifecurve.operators.ordered import arrange


def test_nominal_level(spark, layout):
    rows = [("flat", 0.0, 1.0, 4.0), ("flat", 3600.0, 1.0, 4.0), ("neg", 0.0, -1.0, 3.5), ("neg", 3600.0, -1.0, 3.5)]
    rows += [("ramp", 36.0 * i, 1.0, 3.0 + i / 100) for i in range(101)]
    rows += [("single", 0.0, 1.0, 4.0), ("idle", 0.0, 0.0, 4.0), ("idle", 9.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, t double, i double, v double")
    got = {r.k: r.nominal for r in curves.nominal_level(df, ["k"], "t", "i", "v").collect()}
    assert got["flat"] == 4.0 and got["neg"] == 3.5 and got["ramp"] == pytest.approx(3.5)
    assert got["single"] is None and got["idle"] is None


def test_phase_capacity_and_running_charge(spark, layout):
    rows = [("c", "charge", 60.0 * i, 2.0) for i in range(61)] + [("c", "discharge", 60.0 * i, -1.5) for i in range(61)]
    df = spark.createDataFrame(rows, "k string, phase string, t double, i double").withColumn("v", F.lit(1.0))
    row = curves.phase_capacity(df, ["k"], "phase", "t", "i").first()
    assert (row.cap_chg_ah, row.cap_dis_ah, row.ce) == (pytest.approx(2.0), pytest.approx(1.5), pytest.approx(0.75))
    q = [r.q for r in curves.half_cycle(df, ["k"], "phase", "charge", "t", "i", "v").orderBy("t").collect()]
    assert q[0] == 0.0 and q[-1] == pytest.approx(2.0) and q == sorted(q)


def test_tier_b(spark):
    nominal = [("a", c, p, v) for c in range(1, 6) for p, v in (("charge", 4.20), ("discharge", 3.51 - c / 100))]
    nominal += [("b", c, "charge", 4.2) for c in (1, 2)]
    window = [("a", c) for c in range(1, 6)] + [("b", 1), ("b", 2)]
    out = curves.tier_b(
        spark.createDataFrame(nominal, "e string, c int, p string, nominal double"),
        spark.createDataFrame(window, "e string, c int"),
        "e", "c", "p",
    )
    got = {r.e: r for r in out.collect()}
    ratios = [(3.51 - c / 100) / 3.50 for c in range(1, 6)]
    mean = sum(ratios) / 5
    assert got["a"].discharge_nominal_voltage_retention_max == pytest.approx(1.0)
    assert got["a"].charge_nominal_voltage_retention_max == pytest.approx(1.0)
    assert got["a"].discharge_nominal_voltage_retention_std == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in ratios) / 4))
    assert got["b"].discharge_nominal_voltage_retention_max is None


def gauss(name, mu, n=1700, height=1.0, sigma=0.05):
    return [(name, 2.5 + i / 1000, height * math.exp(-(((2.5 + i / 1000) - mu) ** 2) / (2 * sigma**2))) for i in range(n)]


def test_dominant_peak(spark):
    rows = gauss("one", 3.70) + gauss("neg", 3.70, height=-2.0)
    two = [(n, x, y + 0.6 * math.exp(-((x - 3.2) ** 2) / (2 * 0.03**2))) for n, x, y in gauss("two", 3.70)]
    rows += two + [("flat", 3.0 + i / 100, 0.0) for i in range(50)] + [("short", 1.0 + i, float(i == 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {r.k: r for r in curves.dominant_peak(df, ["k"], "x", "y").collect()}
    assert set(got) == {"one", "neg", "two"}
    assert got["one"].peak_x == pytest.approx(3.70, abs=0.002) and got["one"].n_peaks == 1
    assert got["neg"].peak_y == pytest.approx(-2.0, abs=1e-3)
    assert got["two"].peak_x == pytest.approx(3.70, abs=0.002) and got["two"].n_peaks == 2


def brute_peaks(y, prominence, distance):
    """Plain definition on a curve without plateaus."""
    peaks = [i for i in range(1, len(y) - 1) if y[i - 1] < y[i] > y[i + 1]]
    kept = list(peaks)
    for i in sorted(peaks, key=lambda p: (-y[p], -p)):
        if i in kept:
            kept = [j for j in kept if j == i or abs(j - i) >= distance]
    out = []
    for i in kept:
        left = i
        while left > 0 and y[left - 1] <= y[i]:
            left -= 1
        right = i
        while right < len(y) - 1 and y[right + 1] <= y[i]:
            right += 1
        if y[i] - max(min(y[left : i + 1]), min(y[i : right + 1])) >= prominence * max(y):
            out.append(i)
    return out


@pytest.mark.parametrize("distance", [1, 7])
def test_dominant_peak_brute_force(spark, layout, distance):
    rng = random.Random(distance)
    series = {f"c{k}": [rng.random() for _ in range(60)] for k in range(6)}
    rows = [(k, float(i), v) for k, ys in series.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    if layout == "chunked":
        spark.conf.set("lifecurve.chunkRows", "50")
    got = {r.k: (r.peak_x, r.n_peaks) for r in curves.dominant_peak(df, ["k"], "x", "y", distance=distance).collect()}
    for k, ys in series.items():
        found = brute_peaks(ys, 0.05, distance)
        assert got[k] == (float(max(found, key=lambda i: ys[i])), len(found))


def test_interpolation_is_flat_beyond_the_ends(spark, layout):
    curve = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 4.0, 0.0)], "k string, x double, y double")
    points = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0]
    grid = spark.createDataFrame([("a", i, x) for i, x in enumerate(points)], "k string, i long, x double")
    got = [r.y for r in curves.interpolate(curve, grid, ["k"], "x", "y").orderBy("i").collect()]
    assert got == [10.0, 10.0, 15.0, 20.0, 10.0, 0.0, 0.0]


def test_grid_of_disjoint_curves_is_empty(spark):
    a = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "k string, x double")
    b = spark.createDataFrame([("k", 3.0), ("k", 4.0)], "k string, x double")
    assert curves.common_grid(a, b, ["k"], "x", 0.1).count() == 0
    assert curves.common_grid(a, a, ["k"], "x", 0.25).count() == 5


def test_same_curve_twice(spark):
    df = spark.createDataFrame([("a", 3.0 + i / 50, math.sin(i / 5)) for i in range(40)], "k string, x double, y double")
    assert curves.cosine_similarity(df, df, ["k"], "x", "y").first().cosine == pytest.approx(1.0)
    cap = spark.createDataFrame([("a", 2.0)], "k string, capacity double")
    row = curves.delta_q_stats(df, df, ["k"], "x", "y", cap).first()
    assert (row.dqv_norm_c5_c1_mean, row.dqv_norm_c5_c1_min, row.dqv_norm_c5_c1_var_log10) == (0.0, 0.0, None)
    twice = df.withColumn("y", F.abs("y") + 0.5)
    row = curves.delta_q_stats(df, twice, ["k"], "x", "y", cap).first()
    assert row.dqv_norm_c5_c1_mean == pytest.approx(0.25)


def test_smoothed_derivative_of_a_cubic(spark):
    df = spark.createDataFrame([("a", i / 1000, (i / 1000) ** 3) for i in range(300)], "k string, x double, y double")
    out = curves.smoothed_derivative(df, ["k"], "x", "y").collect()
    assert len(out) == 250
    assert all(abs(r.slope - 3 * r.x**2) < 1e-6 for r in out)


def test_decay_fit_recovers_the_curve(spark):
    tf, ts, beta, af, as_ = 120.0, 2000.0, 0.9, 30.0, 70.0
    rows = [("a", 20.0 * i, af * math.exp(-20.0 * i / tf) + as_ * math.exp(-((20.0 * i / ts) ** beta))) for i in range(300)]
    rows += [("none", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, t double, y double")
    got = {r.k: r for r in curves.decay_fit(df, ["k"], "t", "y").collect()}
    fit = got["a"]
    assert fit.success and fit.r_squared > 0.9999
    assert fit.A_fast_frac == pytest.approx(30.0, abs=4.0)
    assert fit.tau_slow == pytest.approx(ts, rel=0.1)
    assert not got["none"].success and got["none"].error_msg == "non-converged"


def test_ratio_helpers(spark):
    row = spark.range(1).select(
        *[v.alias(n) for n, v in curves.engineered_ratios([F.lit(1.0), F.lit(None).cast("double"), F.lit(0.3)]).items()]
    ).first()
    assert row.A_slow_to_fast_mean == 99.0 and row.A_slow_to_fast_delta is None and row.log_A_slow_to_fast_delta is None


def test_theta_ties_take_the_first(spark):
    rows = [("a", 1, "charge", 10.0, 5.0, 0), ("a", 1, "charge", 20.0, 5.0, 1), ("a", 5, "charge", 15.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "e string, c int, d string, theta double, rho double, p int")
    row = curves.theta_features(df, "e", "c", "d", "theta", "rho", "p").first()
    assert (row.dop_peak_theta_c1_chg, row.dop_peak_theta_shift_chg_c1c5, row.n_features_success) == (10.0, 5.0, 3)


def test_first_minutes(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (100, 160, 220, 400)], "k string, t double")
    assert curves.first_minutes(df, ["k"], "t", 2).count() == 3


def test_segments_start_empty(spark, layout):
    df = spark.createDataFrame([("a", float(t), 2.0) for t in range(40)], "k string, t double, i double")
    rows = curves.with_segments(arrange(df, ["k"], ["t"]), "t", seg=F.col("i")).rows().orderBy("t").collect()
    assert rows[0].dt is None and rows[0].seg is None
    assert all((r.dt, r.seg) == (1.0, 2.0) for r in rows[1:])


@pytest.mark.parametrize("prominence, distance, top", [(0.3, 1, 4), (0.3, 4, 9)])
def test_peaks_in_rounds_equal_the_walk(spark, prominence, distance, top):
    """Many equal heights, so ties and flat tops count; every curve through the rounds."""
    rnd = np.random.default_rng(top)
    rows = []
    for key in range(6):
        values = rnd.integers(0, top, 150) if key < 4 else np.abs(np.cumsum(rnd.integers(-2, 3, 150)))
        rows += [(key, float(i), float(v) * (-1 if i % 5 == 0 else 1)) for i, v in enumerate(values)]
    rows += [(9, float(i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    options = {"prominence": prominence, "distance": distance, "min_points": 5}
    walk = sorted(map(tuple, curves.dominant_peak(df, ["k"], "x", "y", **options).collect()))
    rounds = sorted(map(tuple, curves.dominant_peak(df, ["k"], "x", "y", max_turns=1, **options).collect()))
    assert walk == rounds and len(walk) >= 5
