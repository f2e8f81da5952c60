"""Metrics against hand values and brute force, with whole and with split keys."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lifecurve.operators import metrics, ranks, rollup, survival


def predictions(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rng.random() < 0.8 else "cold"
        rows.append((i, g, rng.randint(1, 15), rng.random() < 0.6, float(rng.randint(0, 12)), rng.randint(0, 1)))
    cols = "id int, g string, time int, event boolean, risk double, y int"
    return rows, spark.createDataFrame(rows, cols).repartition(3)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_and_roc(spark, layout):
    rows, df = predictions(spark)
    got = {r.g: r.auc for r in ranks.roc_auc(df, ["g"], "y", "risk").collect()}
    for g in ("hot", "cold"):
        assert got[g] == pytest.approx(brute_auc([(r[5], r[4]) for r in rows if r[1] == g]))
    whole = ranks.roc_auc(df, [], "y", "risk").first().auc
    assert whole == pytest.approx(brute_auc([(r[5], r[4]) for r in rows]))
    for p in ranks.roc_points(df, ["g"], "y", "risk").collect():
        mine = [r for r in rows if r[1] == p.g]
        assert p.tp == sum(r[5] == 1 and r[4] >= p.threshold for r in mine)
        assert p.fp == sum(r[5] == 0 and r[4] >= p.threshold for r in mine)
        assert p.tp + p.fn + p.fp + p.tn == len(mine)
    assert ranks.roc_auc(df.where("y = 1"), [], "y", "risk").first().auc is None


def test_quantiles(spark, layout):
    rows, df = predictions(spark)
    got = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "risk", {"m": 0.5, "q": 0.9}).collect()}
    for g in ("hot", "cold"):
        v = sorted(r[4] for r in rows if r[1] == g)
        assert got[g].m == pytest.approx(statistics.median(v))
        h = 0.9 * (len(v) - 1)
        lo = v[int(h)]
        assert got[g].q == pytest.approx(lo + (v[min(int(h) + 1, len(v) - 1)] - lo) * (h - int(h)))


def brute_c(rows):
    won = pairs = 0
    for a in rows:
        for b in rows:
            if a[3] and (a[2] < b[2] or (a[2] == b[2] and not b[3])):
                pairs += 1
                won += (a[4] > b[4]) + 0.5 * (a[4] == b[4])
    return pairs, won / pairs


def test_concordance(spark, layout):
    rows, df = predictions(spark)
    got = {r.g: r for r in survival.concordance(df, ["g"], "time", "event", "risk").collect()}
    for g in ("hot", "cold"):
        pairs, c = brute_c([r for r in rows if r[1] == g])
        assert got[g].n_pairs == pairs
        assert got[g].c_index == pytest.approx(c)
    pairs, c = brute_c(rows)
    whole = survival.concordance(df, [], "time", "event", "risk").first()
    assert (whole.n_pairs, whole.c_index) == (pairs, pytest.approx(c))


def test_concordance_extremes(spark):
    df = spark.range(1, 51).select(F.col("id").alias("t"), F.lit(True).alias("e"), (-F.col("id")).cast("double").alias("r"))
    assert survival.concordance(df, [], "t", "e", "r").first().c_index == 1.0
    assert survival.concordance(df.withColumn("r", -F.col("r")), [], "t", "e", "r").first().c_index == 0.0
    one = df.withColumn("e", F.col("t") == 1)
    assert survival.concordance(one, [], "t", "e", "r").first().c_index is None


def test_survival_curve(spark, layout):
    rows, df = predictions(spark)
    got = {(r.g, r.time): r for r in survival.survival_curve(df, ["g"], "time", "event").collect()}
    for g in ("hot", "cold"):
        mine = [r for r in rows if r[1] == g]
        s = 1.0
        for t in sorted({r[2] for r in mine}):
            n = sum(r[2] >= t for r in mine)
            d = sum(r[2] == t and r[3] for r in mine)
            s *= 1 - d / n
            assert (got[(g, t)].n_at_risk, got[(g, t)].n_events) == (n, d)
            assert got[(g, t)].survival == pytest.approx(s, abs=1e-9)
    short = spark.createDataFrame([(1, True), (2, False), (3, False)], "time int, event boolean")
    curve = survival.survival_curve(short, [], "time", "event")
    assert survival.median_survival(curve, [], 99).first().median_time == 99.0


def test_horizon_metrics(spark):
    rows = [(1, 100, 10.0), (1, 200, 8.0), (0, 500, 1.0), (0, 600, 0.5), (0, 250, 99.0)]
    df = spark.createDataFrame(rows, "event int, time int, risk double")
    assert survival.auc_at_horizon(df, [], "time", "event", "risk", 300).first()[0] == 1.0
    assert survival.f1_at_horizon(df, [], "time", "event", "risk", 300).first()[0] == 1.0
    assert survival.auc_at_horizon(df, [], "time", "event", "risk", 50).first()[0] is None
    # Without censoring in the training rows all weights are 1.
    train = df.withColumn("event", F.lit(1))
    assert survival.dynamic_auc(train, df.where("risk < 50"), [], "time", "event", "risk", 300).first()[0] == 1.0


def test_classification_table(spark, layout):
    rows = [(1, 1, 0.9, "A"), (0, 0, 0.1, "A"), (1, 0, 0.4, "A"), (0, 1, 0.6, "B"), (0, 0, 0.2, "B"), (0, 0, 0.3, None)]
    df = spark.createDataFrame(rows, "y int, p int, s double, c string")
    got = {r.scope: r for r in metrics.classification_metrics(df, [], "y", "p", "s", "c").collect()}
    assert set(got) == {"all", "A", "B"}
    assert got["all"].n == 6 and got["all"].accuracy == pytest.approx(4 / 6)
    assert got["all"].f1 == pytest.approx(0.5) and got["all"].roc_auc == pytest.approx(7 / 8)
    assert got["B"].roc_auc is None and got["B"].precision == 0.0 and got["B"].recall == 0.0


def test_regression_table(spark, layout):
    rng = random.Random(1)
    rows = [("a" if i % 4 else "b", rng.uniform(1, 9), rng.uniform(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, y double, p double")
    got = {r.scope: r for r in metrics.regression_metrics(df, [], "y", "p", "c").collect()}
    for scope in ("all", "a", "b"):
        mine = [(y, p) for c, y, p in rows if scope in ("all", c)]
        errs = [abs(p - y) for y, p in mine]
        mean = sum(y for y, _ in mine) / len(mine)
        assert got[scope].mae == pytest.approx(sum(errs) / len(errs))
        assert got[scope].medae == pytest.approx(statistics.median(errs))
        assert got[scope].r2 == pytest.approx(1 - sum(e * e for e in errs) / sum((y - mean) ** 2 for y, _ in mine))


def test_ensemble_and_zscore(spark, layout):
    rows = [(s, c, p) for s, ps in ((1, (0.9, 0.4, 0.1)), (2, (0.8, 0.5, 0.2))) for c, p in zip("abc", ps)]
    df = spark.createDataFrame(rows, "seed int, cell string, p double")
    got = {r.cell: (round(r.proba_mean, 6), r.pred) for r in rollup.ensemble(df, "cell", "p").collect()}
    assert got == {"a": (0.85, 1), "b": (0.45, 0), "c": (0.15, 0)}
    flat = rollup.zscore(df.withColumn("p", F.lit(0.5)), ["seed"], "p", "z")
    assert {r.z for r in flat.collect()} == {0.0}


def test_fingerprint_ignores_order_and_sees_changes(spark, layout):
    df = spark.range(200).select(F.lit("g").alias("k"), F.col("id").alias("name"))
    mixed = df.orderBy(F.rand(1)).unionByName(df.limit(3))
    assert rollup.same_sets(df, mixed, ["k"], "name").first().same
    assert not rollup.same_sets(df, df.where("name > 0"), ["k"], "name").first().same
    prints = [r.fingerprint for d in (df, mixed, df.where("name > 0")) for r in rollup.set_fingerprint(d, ["k"], "name").collect()]
    assert prints[0] == prints[1] != prints[2]


def test_sets_do_not_depend_on_their_neighbours(spark, layout):
    """One key is small on both sides, another large on one side only."""
    a = spark.createDataFrame([("x", k) for k in (1, 2)] + [("y", k) for k in range(60)], "k string, name int")
    b = spark.createDataFrame([("x", k) for k in (2, 1)] + [("y", 1), ("z", 4)], "k string, name int")
    got = {r.k: (r.n_a, r.n_b, r.same) for r in rollup.same_sets(a, b, ["k"], "name").collect()}
    assert got == {"x": (2, 2, True), "y": (60, 1, False), "z": (None, 1, False)}
    alone = rollup.set_fingerprint(a.where("k = 'x'"), ["k"], "name").first().fingerprint
    assert {r.k: r.fingerprint for r in rollup.set_fingerprint(a, ["k"], "name").collect()}["x"] == alone


def test_simplex_has_286_points():
    grid = rollup.simplex(4, 10)
    assert len(grid) == len(set(grid)) == 286
    assert all(abs(sum(w) - 1) < 1e-9 for w in grid)


def test_student_p_values(spark):
    # Known two-sided values: t=2.776 at 4 degrees, t=1.96 at a large number, t=12.706 at 1.
    df = spark.createDataFrame([(2.7764451, 4, 0.05), (1.9599640, 1_000_000, 0.05), (12.7062047, 1, 0.05), (0.0, 7, 1.0), (2.2281389, 10, 0.05)], "t double, dof long, p double")
    for r in df.select("p", rollup.student_p_value(F.col("t"), F.col("dof")).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=2e-4)


def test_paired_notes(spark):
    df = spark.createDataFrame([(1, 200, 0.5), (1, 300, 0.6), (2, 200, 0.7)], "seed int, n int, f1 double")
    row = rollup.paired_summary(rollup.paired_deltas(df, "seed", "n", ["f1"])).first()
    assert (row.n_seeds, row.delta_pp, row.note) == (1, None, "fewer than 2 paired seeds")


def test_bootstrap_covers_the_mean(spark, layout):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(70)], "k string, i int, v double")
    row = rollup.bootstrap_mean_ci(df, ["k"], "v", ["i"], replicates=200).first()
    assert row.ci_lo < 3.0 < row.ci_hi and row.ci_hi - row.ci_lo < 2.0


def test_rank_calibration(spark, layout):
    rows = [("f", i, float(i), 100 - i) for i in range(40)]
    df = spark.createDataFrame(rows, "fold string, e int, risk double, life int")
    got = {r.e: r.calibrated_life for r in ranks.rank_calibration(df, "fold", "e", "risk", "life").collect()}
    assert got == {i: 100 - i for i in range(40)}


def test_blend_verdict(spark):
    rows = [(s, w, c) for s in (1, 2) for w, c in ((0.0, 0.5), (0.5, 0.9 + s / 1000), (1.0, 0.6))]
    df = spark.createDataFrame(rows, "seed int, w double, c_index double")
    row = rollup.blend_summary(df).first()
    assert (row.best_weight, row.verdict) == (0.5, "blend wins")
    assert row.delta == pytest.approx(0.3015)


@pytest.mark.parametrize("margin", [3.0, 0.0])
def test_quantiles_of_large_keys(spark, layout, monkeypatch, margin):
    """Brackets without width miss their ranks; the values are the exact ones all the same."""
    monkeypatch.setattr(ranks, "PERCENTILE_ROWS", 10)
    monkeypatch.setattr(ranks, "SKETCH_MARGIN", margin)
    v = F.when(F.col("id") % 50 < 40, 7.0).otherwise(F.hash("id") / 1e6)
    df = spark.range(900).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), v.alias("v"))
    probs = {"low": 0.013, "mid": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}
    for keys in (["g"], []):
        want = {r.asDict().get("g"): r for r in df.groupBy(*keys).agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()}
        got = {r.asDict().get("g"): r for r in ranks.exact_quantiles(df, keys, "v", probs).collect()}
        assert got.keys() == want.keys()
        for g, r in want.items():
            assert [got[g][n] for n in probs] == pytest.approx([r[n] for n in probs])


def test_horizons_in_one_pass(spark, layout):
    """The same figures as one horizon at a time, with tied and missing risks and keys without a class."""
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(1, 60), rng.random() < 0.5, rng.choice([None, *range(8)])) for _ in range(300)]
    rows += [("one", 9, True, 1), ("late", 90, False, 2), ("late", 91, True, 3), ("gone", 1, False, 1), ("blank", 9, True, None), ("blank", 99, True, None)]
    rows = [(k, t, e, None if r is None else float(r)) for k, t, e, r in rows]
    df = spark.createDataFrame(rows, "k string, time int, event boolean, risk double")
    got = {r.k: r.asDict() for r in survival.horizon_metrics(df, ["k"], "time", "event", "risk", (20, 40)).collect()}
    assert len(got) == 7
    for n in (20, 40):
        for fn, name in ((survival.auc_at_horizon, f"auc_at_{n}"), (survival.f1_at_horizon, f"f1_at_{n}")):
            want = {r.k: r[name] for r in fn(df, ["k"], "time", "event", "risk", n).collect()}
            for k in got:
                assert got[k][name] == (None if want.get(k) is None else pytest.approx(want[k])), (k, name)
    whole = survival.horizon_metrics(df, [], "time", "event", "risk", (20,)).first()
    assert whole[0] == pytest.approx(survival.auc_at_horizon(df, [], "time", "event", "risk", 20).first()[0])
    assert whole[1] == pytest.approx(survival.f1_at_horizon(df, [], "time", "event", "risk", 20).first()[0])
