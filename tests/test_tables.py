"""Label cascade, readers, writers, roles, audits and the end-to-end builds."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lifecurve.functions import roles, scalars
from lifecurve.operators import audit, labels, learn, rollup
from lifecurve.plans import build, curation, models
from lifecurve.sources import readers, writers


def events(values, charge=None, start=1):
    out = [{"event_kind": "formation", "cd_index": 0, "regular_cycle": None, "capacity_discharge_ah": 1.0}]
    for i, v in enumerate(values):
        chg = v if charge is None else charge[i]
        out.append(
            {
                "event_kind": "regular_cd",
                "cd_index": i + 1,
                "regular_cycle": start + i,
                "capacity_discharge_ah": v,
                "capacity_charge_ah": chg,
                "coulombic_efficiency": 0.99,
            }
        )
    return out


def doc(name, values, consistency="single_rate", regimes=None, **kw):
    return {
        "cell_name": name,
        "cycling_consistency": consistency,
        "protocol_pattern": "p1",
        "cd_events": events(values, **kw),
        "regular_rate_regimes": regimes if regimes is not None else [{"n_regular_cd": len(values), "baseline_i_a": 1.0}],
    }


FADED = [1.0] * 10 + [0.8] * 10
STEADY = [1.0] * 20
DOCS = [
    doc("AR_steady", STEADY),
    doc("0MC_faded", FADED),
    doc("AR_changed", STEADY, "rate_changed", [{"n_regular_cd": 6, "baseline_i_a": 1.0}, {"n_regular_cd": 14, "baseline_i_a": 2.0}]),
    doc("AR_changed_early", STEADY, "rate_changed", [{"n_regular_cd": 4, "baseline_i_a": 1.0}]),
    doc("AR_none", [], "no_regular", []),
    doc("AR_empty", []),
    doc("AR_low", [0.05] + [1.0] * 9),
    doc("AR_low_charge", [1.0] * 10, charge=[1.0, 0.01] + [1.0] * 8),
    doc("AR_late", [1.0] * 10, start=3),
    doc("AR_review", STEADY),
    doc("AR_event", STEADY),
    doc("AR_censor", FADED),
    doc("AR_cut", FADED),
    doc("AR_masked", [1.0] * 17 + [0.7, 0.7, 0.7]),
]
DECISIONS = {
    "AR_review": dict(exclude_from_ml=True, last_available_cycle=None, event_type=None, reason="r", validated_at="2024-01-01", n_regular_at_review=20),
    "AR_event": dict(exclude_from_ml=False, last_available_cycle=12, event_type="event", reason="r", validated_at="2024-01-01", n_regular_at_review=20),
    "AR_censor": dict(exclude_from_ml=False, last_available_cycle=None, event_type="censor", reason="r", validated_at="2024-01-01", n_regular_at_review=20),
    "AR_cut": dict(exclude_from_ml=False, last_available_cycle=10, event_type=None, reason="r", validated_at="2024-01-01", n_regular_at_review=20),
}
SIDECAR = {"AR_masked": {"n_outliers": 3, "outliers": [{"cycle": c, "z_score": 9.0} for c in (18, 19, 20)]}, "AR_steady": {"n_outliers": 0, "outliers": []}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "annotations").mkdir()
    for d in DOCS:
        (root / "annotations" / f"{d['cell_name']}.json").write_text(json.dumps(d, indent=1))
    (root / "annotations" / "broken.json").write_text("{not json")
    (root / "decisions.json").write_text(json.dumps(DECISIONS, indent=1))
    (root / "sidecar.json").write_text(json.dumps(SIDECAR))
    return root


def test_documents_and_rejects(spark, files):
    good, bad = readers.read_documents(spark, f"{files}/annotations")
    assert good.count() == len(DOCS) and bad.count() == 1
    assert bad.first().source_file.endswith("broken.json")
    cycles = readers.flatten_cycles(good)
    assert cycles.where("cell_name = 'AR_steady'").count() == 20
    assert readers.flatten_regimes(good).where("cell_name = 'AR_changed'").count() == 2


def test_label_table(spark, files, layout):
    out = build.label_table(spark, f"{files}/annotations", f"{files}/decisions.json", f"{files}/sidecar.json", horizons=(10, 15))
    got = {r.cell_name: r for r in out.collect()}
    assert len(got) == len(DOCS)
    reasons = {k: r.exclusion_reason for k, r in got.items() if r.exclusion_reason}
    assert reasons == {
        "AR_changed": "rate_changed",
        "AR_changed_early": "rate_changed",
        "AR_none": "no_regular",
        "AR_empty": "no_baseline",
        "AR_low": "low_initial_capacity",
        "AR_low_charge": "low_initial_capacity",
        "AR_late": "no_baseline",
        "AR_review": "human_review",
    }
    assert {k for k, r in got.items() if r.status == "excluded"} == set(reasons)
    assert all(not r.trainable_n10 and r.label_n10 == "excluded" for r in got.values() if r.status == "excluded")
    s = got["AR_steady"]
    assert (s.cohort, s.status, s.n_regular, s.final_retention, s.label_n10, s.label_n15) == ("AR", "in_testing", 20, 1.0, "pass", "pass")
    f = got["0MC_faded"]
    assert (f.cohort, f.status, f.last_fade_cycle, f.label_n10, f.label_n15) == ("0MC", "faded", 11, "pass", "bad")
    c = got["AR_changed"]
    assert (c.n_regular, c.baseline_dis_ah, c.n_regular_pre_rate_change) == (20, 1.0, 6)
    assert (got["AR_changed_early"].n_regular, got["AR_changed_early"].baseline_dis_ah) == (0, None)
    e = got["AR_event"]
    assert (e.status, e.last_fade_cycle, e.n_regular, e.truncation_cycle, e.label_n15) == ("faded", 12, 12, 12, "bad")
    n = got["AR_censor"]
    assert (n.status, n.last_fade_cycle, n.n_regular, n.final_retention) == ("in_testing", None, 20, 0.8)
    t = got["AR_cut"]
    assert (t.status, t.n_regular, t.truncation_cycle, t.label_n15) == ("in_testing", 10, 10, "censor")
    m = got["AR_masked"]
    assert (m.status, m.n_regular, m.n_outliers_masked, m.final_retention) == ("in_testing", 20, 3, 1.0)


def test_missing_overlays_are_empty(spark, files):
    assert readers.read_decisions(spark, f"{files}/nowhere.json").count() == 0
    assert readers.read_outliers(spark, f"{files}/nowhere.json").count() == 0
    assert readers.read_decisions(spark, f"{files}/decisions.json").count() == 4
    assert readers.read_outliers(spark, f"{files}/sidecar.json").count() == 3


def test_eligibility_window(spark, layout):
    def rows(name, cycles):
        return [(name, c, 1.0, 1.0, 0.99, c) for c in cycles]

    data = rows("gap", (1, 2, 4, 5, 6)) + rows("full", range(1, 9)) + rows("late", range(2, 9)) + rows("short", range(1, 5))
    data += [("hole", c, 1.0, None if c == 3 else 1.0, 0.99, c) for c in range(1, 9)]
    cycles = spark.createDataFrame(
        data, "cell_name string, regular_cycle int, capacity_discharge_ah double, capacity_charge_ah double, coulombic_efficiency double, cd_index int"
    )
    cells = cycles.select("cell_name").distinct().withColumns({"cycling_consistency": F.lit("single_rate"), "first_regime_n": F.lit(9)})
    at1 = {r.cell_name: r["count"] for r in labels.feature_window(cells, cycles).groupBy("cell_name").count().collect()}
    at3 = {r.cell_name: r["count"] for r in labels.feature_window(cells, cycles, baseline_cycle=3).groupBy("cell_name").count().collect()}
    assert at1 == {"gap": 5, "full": 5} and at3 == {"full": 3}


def test_tier_a(spark):
    dis, chg, ce = [1, 0.98, 0.97, 0.96, 0.95], [1, 0.99, 0.85, 0.975, 0.97], [1, 1, 1, 1, 0.979]
    rows = [("a", i + 1, float(d), float(c), float(e), 1.0, 1.0) for i, (d, c, e) in enumerate(zip(dis, chg, ce))]
    df = spark.createDataFrame(
        rows,
        "cell_name string, regular_cycle int, capacity_discharge_ah double, capacity_charge_ah double, coulombic_efficiency double, baseline_discharge double, baseline_charge double",
    )
    r = labels.tier_a(df).first()
    assert (r.coulombic_efficiency_final, r.discharge_capacity_retention_final, r.charge_capacity_retention_min) == (pytest.approx(97.9), 0.95, 0.85)


def test_feature_build(spark):
    cells = spark.createDataFrame([("a", "single_rate", 9), ("b", "no_regular", 0)], "cell_name string, cycling_consistency string, first_regime_n int")
    cycles = spark.createDataFrame(
        [(n, c, 1.0 - c / 100, 1.0, 0.99, c) for n in "ab" for c in range(1, 7)],
        "cell_name string, regular_cycle int, capacity_discharge_ah double, capacity_charge_ah double, coulombic_efficiency double, cd_index int",
    )
    samples = spark.createDataFrame(
        [("a", c, p, 60.0 * i, s, 3.5 + c / 100) for c in range(1, 7) for p, s in (("charge", 1.0), ("discharge", -1.0)) for i in range(4)],
        "cell_name string, cd_index int, cd_phase string, elapsed_time double, current double, voltage double",
    )
    plateau = spark.createDataFrame(
        [("a", c, 20.0 * i, 0.03 * math.exp(-i / 6) + 0.07 * math.exp(-((i / 100) ** 0.9))) for c in (3, 4) for i in range(300)],
        "cell_name string, cd_index int, t_s double, current double",
    )
    features, status = build.feature_tables(cells, cycles, samples, plateau)
    assert features.columns == ["cell_name", *roles.FEATURES] and len(roles.FEATURES) == 40
    row = features.collect()
    assert len(row) == 1 and row[0].cell_name == "a"
    assert row[0].discharge_nominal_voltage_retention_max == pytest.approx(3.55 / 3.51)
    assert row[0].cv_A_fast_frac_c3 == pytest.approx(30.0, abs=5) and row[0].cv_A_fast_frac_c5 is None
    assert row[0].cv_A_fast_frac_mean is not None and row[0].cv_A_fast_frac_delta is None
    assert {r.regular_cycle: (r.success, r.error_msg) for r in status.collect()} == {3: (True, ""), 4: (True, ""), 5: (False, "no samples")}


def test_roles(spark):
    table = roles.role_table()
    assert set(roles.label_columns()) | set(roles.FEATURES) == set(table)
    assert {"truncation_cycle", "n_outliers_masked"} <= set(table)
    parts = [roles.subset_columns(n, table) for n in ("fs_a_only", "fs_b_only", "fs_c_only")]
    assert [len(p) for p in parts] == [3, 3, 34]
    assert sorted(sum(parts, [])) == sorted(roles.subset_columns("fs_all", table))
    assert roles.subset_columns("fs_ab", table) == parts[0] + parts[1]
    assert roles.subset_columns("fs_all", table, {"fs_all": ["x"]}) == ["x"]
    df = spark.createDataFrame([("a", "AR", "pass", 1.0)], "cell_name string, cohort string, label_n200 string, beta double")
    with pytest.raises(ValueError):
        roles.training_matrix(df, ["cell_name"], ["label_n200"], table)
    with pytest.raises(ValueError):
        roles.training_matrix(df, ["cell_name"], ["cohort"], table)
    with pytest.raises(KeyError):
        roles.training_matrix(df, ["cell_name"], ["nowhere"], table)
    with pytest.raises(ValueError):
        roles.check_columns(df, ["cell_name"])


def test_snapshots_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    writers.write_snapshot(df, str(tmp_path), "20240101_0000")
    writers.write_snapshot(df.where("k = 'a'"), str(tmp_path), "20240102_0000")
    assert writers.read_latest(spark, str(tmp_path)).count() == 1
    writers.promote(spark, str(tmp_path), "20240101_0000")
    rows = {r.k: r.v for r in writers.read_latest(spark, str(tmp_path)).collect()}
    assert rows == {"a": 1.0, "b": None}
    writers.write_with_mirror(df, str(tmp_path / "out"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 2
    new = spark.createDataFrame([("b", 5.0, 1), ("c", 6.0, 1), ("c", 7.0, 2)], "k string, w double, _seq int")
    up = {r.k: (r.v, r.w) for r in writers.upsert(df.where("k <> 'x'").withColumn("_seq", F.lit(0)), new, ["k"]).collect()}
    assert up == {"a": (1.0, None), "b": (None, 5.0), "c": (None, 7.0)}


def test_snapshot_resolution(spark):
    rows = [("s1", "f"), ("s1", "l"), ("s2", "f"), ("s2", "l"), ("s3", "l"), ("", "f"), ("", "l")]
    df = spark.createDataFrame(rows, "snapshot string, file string")
    need = ["f", "l"]
    assert readers.resolve_snapshot(df, need, pinned="s9") == "s9"
    assert readers.resolve_snapshot(df, need, latest="s1") == "s1"
    assert readers.resolve_snapshot(df, need, latest="s3") == "s2"
    assert readers.resolve_snapshot(df.where("snapshot in ('s3', '')"), need, latest="s3") == ""
    assert readers.resolve_snapshot(df.where("snapshot = 's3'"), need, latest="s3") == "s3"


def test_run_discovery(spark, tmp_path):
    for i, (model, n) in enumerate([("rf", 200), ("rf", 300), ("gbt", 200)]):
        d = tmp_path / "runs" / f"N={n}" / f"run{i}"
        d.mkdir(parents=True)
        (d / "manifest.json").write_text(json.dumps({"model": model, "N": n}))
        (d / "summary.json").write_text(json.dumps({"test_auc": 0.5 + i / 10}))
    manifests = readers.read_manifests(spark, f"{tmp_path}/runs/*/*/manifest.json", "model string, N int")
    assert readers.find_runs(manifests, model="rf", N=None).count() == 2
    assert readers.find_runs(manifests, model="rf", N=200).first().run_dir == "run0"
    out = readers.read_summaries(spark, f"{tmp_path}/runs/*/*/summary.json", "test_auc double", manifests)
    assert {(r.run_dir, r.model, r.test_auc) for r in out.collect()} == {("run0", "rf", 0.5), ("run1", "rf", 0.6), ("run2", "gbt", 0.7)}


def test_samples_reader(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 9)], "cell_name string, v double, extra int").write.parquet(f"{tmp_path}/s/p=1")
    spark.createDataFrame([("b", 2.0)], "cell_name string, v double").write.parquet(f"{tmp_path}/s/p=2")
    wanted = spark.createDataFrame([("b",), ("b",)], "cell_name string")
    got = readers.read_samples(spark, f"{tmp_path}/s", ["cell_name", "v"], wanted).collect()
    assert [(r.cell_name, r.v) for r in got] == [("b", 2.0)]


def test_scalars(spark):
    nan = float("nan")
    row = spark.range(1).select(
        scalars.safe_ratio(F.lit(99.0), F.lit(1.0)).alias("a"),
        scalars.safe_ratio(F.lit(99.0), F.lit(0.3)).alias("b"),
        scalars.safe_log_abs(F.lit(-math.e)).alias("c"),
        scalars.safe_log_abs(F.lit(0.0)).alias("d"),
        scalars.signed_shift(F.lit(1.0), F.lit(nan)).alias("e"),
        scalars.same_value(F.lit(nan), F.lit(None)).alias("f"),
        scalars.first_present(F.lit(nan), F.lit(2.0)).alias("g"),
        scalars.joined_list(F.array().cast("array<int>")).alias("h"),
        scalars.cohort_two_way(F.lit("0MC7")).alias("i"),
        scalars.cohort_three_way(F.lit("0MC7")).alias("j"),
        scalars.inverse_target(scalars.transform_target(F.lit(7.0), "boxcox", 0.3), "boxcox", 0.3).alias("k"),
        scalars.inverse_target(F.lit(-99.0), "boxcox", 0.5).alias("l"),
        scalars.inverse_target(scalars.transform_target(F.lit(7.0), "log"), "log").alias("m"),
        scalars.inverse_target(scalars.transform_target(F.lit(7.0), "boxcox", 0.0), "boxcox", 0.0).alias("n"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == (99.0, None, pytest.approx(1.0), None, None, True, 2.0, None)
    assert (row.i, row.j) == ("0MC", "other")
    assert row.k == pytest.approx(7.0) and 0 < row.l < 1e-9 and row.m == pytest.approx(7.0) and row.n == pytest.approx(7.0)


def test_decision_rules(spark):
    rows = [
        ("ok", False, 5, "event", "r", "d"),
        ("no_type", False, 5, None, "r", "d"),
        ("no_cycle", False, None, "event", "r", "d"),
        ("excluded", True, None, None, "r", "d"),
        ("odd", False, 5, "pause", None, "d"),
    ]
    df = spark.createDataFrame(rows, "cell_name string, exclude_from_ml boolean, last_available_cycle int, event_type string, reason string, validated_at string")
    got = {r.cell_name: len(r.errors) for r in audit.decision_errors(df).collect()}
    assert got == {"ok": 0, "no_type": 1, "no_cycle": 1, "excluded": 0, "odd": 2}


def test_decision_text_errors(spark):
    good = {"exclude_from_ml": False, "last_available_cycle": 5, "event_type": "event", "reason": None, "validated_at": "d", "n_regular_at_review": None}
    texts = {
        "good": json.dumps(good),
        "none": None,
        "broken": "{",
        "number": "3",
        "empty": "{}",
        "text_flag": json.dumps(good | {"exclude_from_ml": "false"}),
        "half": json.dumps(good | {"last_available_cycle": 5.5}),
        "free": json.dumps(good | {"last_available_cycle": None}),
        "extra": json.dumps(good | {"z": 1, "a": 2}),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, entry string")
    got = {r.name: r.errors for r in audit.decision_text_errors(df, "entry").collect()}
    assert got["good"] == [] and got["none"] == got["broken"] == ["no JSON"] and got["number"] == ["object expected, found int"]
    assert got["empty"][0].startswith("missing fields: event_type, ") and got["empty"][1] == "exclude_from_ml: bool expected, found null"
    assert got["text_flag"] == ["exclude_from_ml: bool expected, found str"]
    assert got["half"] == ["last_available_cycle: int expected, found float"]
    assert got["free"] == ["an event needs a last_available_cycle"]
    assert got["extra"] == ["unknown fields: a, z"]


def test_line_files(spark, tmp_path):
    lines = [json.dumps({"cell_name": "a", "cd_events": events([1.0, 0.9])}), "{cut", json.dumps({"cycling_consistency": "x"})]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "docs.json").write_text("\n".join(lines))
    (tmp_path / "dec").write_text(json.dumps({"cell_name": "a"} | DECISIONS["AR_event"]))
    (tmp_path / "out").write_text(json.dumps({"cell_name": "a"} | SIDECAR["AR_masked"]))
    good, bad = readers.read_documents(spark, f"{tmp_path}/d", lines=True)
    assert readers.flatten_cycles(good).count() == 2 and bad.count() == 2
    assert readers.read_decisions(spark, f"{tmp_path}/dec", lines=True).first().last_available_cycle == 12
    assert [r.cycle for r in readers.read_outliers(spark, f"{tmp_path}/out", lines=True).collect()] == [18, 19, 20]
    assert readers.read_decisions(spark, f"{tmp_path}/no", lines=True).count() == 0


def test_review_flow(spark):
    decisions = spark.createDataFrame(
        [("old", False, 9, "censor", "r", "d", 100), ("done", False, 9, "censor", "r", "d", 50), ("gone", False, 9, "censor", "r", "d", 5), ("legacy", False, 9, "censor", "r", "d", None)],
        "cell_name string, exclude_from_ml boolean, last_available_cycle int, event_type string, reason string, validated_at string, n_regular_at_review int",
    )
    current = spark.createDataFrame([("old", 120), ("done", 50), ("new", 35), ("both", 40), ("legacy", 7)], "cell_name string, n_regulars int")
    steps = spark.createDataFrame(
        [("done", 5, 0.1, 0.1), ("both", 20, 0.2, 0.3), ("both", 10, 0.1, 0.2)], "cell_name string, sustained_cycle int, jump_magnitude double, persistence double"
    )
    outliers = spark.createDataFrame([("new", 32), ("new", 35), ("new", 3), ("both", 36), ("old", 1), ("clean", None)], "cell_name string, outlier_cycle int")
    got = {r.cell_name: r for r in curation.review_table(steps, outliers, decisions, current).collect()}
    assert {k: r.review_reason for k, r in got.items()} == {
        "old": "decided at 100 cycles, now 120",
        "gone": "decided at 5 cycles, now none",
        "legacy": "decided at unrecorded cycles, now 7",
        "new": "tail_outlier",
        "both": "sustained_step,tail_outlier",
    }
    assert (got["new"].tail_cycles, got["new"].n_outliers_masked, got["new"].template.last_available_cycle) == ("32,35", 3, 35)
    assert (got["both"].sustained_cycle, got["both"].n_extra) == (10, 1)
    assert got["old"].template is None
    filled = {r.cell_name: r.n_regular_at_review for r in audit.fill_review_counts(decisions, current, "cell_name", "n_regular_at_review", "n_regulars").collect()}
    assert filled == {"old": 100, "done": 50, "gone": 5, "legacy": 7}
    with pytest.raises(ValueError):
        curation.review_table(steps, outliers, decisions.withColumn("event_type", F.lit("pause")), current)


def test_reports_from_documents(spark, files):
    good, _ = readers.read_documents(spark, f"{files}/annotations")
    header = {r.cell_name: r for r in curation.document_header(good).collect()}
    assert (header["AR_changed"].regime_boundary_cycles, header["AR_changed"].max_regime_rate_delta_pct) == ("6", 100.0)
    assert header["AR_steady"].regime_boundary_cycles is None
    cycles = readers.flatten_cycles(good)
    none = spark.createDataFrame([], "cell_name string, boundary int")
    report = curation.outlier_report(curation.document_header(good), cycles, none)
    assert report.select("cell_name").distinct().count() == len(DOCS)
    steps = curation.step_report(curation.document_header(good), cycles, none, report)
    flagged = {r.cell_name for r in steps.collect()}
    assert "0MC_faded" in flagged and "AR_changed" not in flagged
    _, verdict = curation.jump_audit(cycles, none, good)
    got = {r.cell_name: r.strongest for r in verdict.collect()}
    assert got["0MC_faded"] == "sustained" and got["AR_steady"] == "none"


def test_agreement_table(spark):
    rows = [("pass", "good", "AR"), ("bad", "bad", "AR"), ("pass", "bad", "AR"), ("bad", "good", "0MC2"), ("censor", "good", "0MC2"), ("excluded", "bad", "AR"), ("odd", "bad", "AR")]
    df = spark.createDataFrame(rows, "ours string, theirs string, cohort string")
    df = df.withColumn("category", audit.agreement_category(F.col("ours"), F.col("theirs")))
    got = {r.scope: (r.n_total, r.n_primary, r.n_agree) for r in audit.agreement_summary(df, "category", "cohort").collect()}
    assert got == {"all": (7, 5, 2), "AR": (5, 4, 2), "0MC2": (2, 1, 0)}
    assert {r.category: r.n for r in audit.category_counts(df, "category").collect()} == {c: 1 for c in audit.CATEGORIES}


def test_splits(spark, layout):
    df = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    held = learn.stratified_holdout(df, "y", "id", test_share=0.2)
    sizes = {(r.y, r.split): r["count"] for r in held.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "test"): 30, (0, "train"): 120, (1, "test"): 10, (1, "train"): 40}
    folds = learn.stratified_folds(df, "y", "id", folds=5)
    assert folds.count() == 200 and folds.select("id").distinct().count() == 200
    assert {r["count"] for r in folds.groupBy("fold", "y").count().where("y = 1").collect()} == {10}
    again = learn.stratified_folds(df.repartition(7), "y", "id", folds=5)
    assert again.join(folds.withColumnRenamed("fold", "f2"), ["id", "y"]).where("fold <> f2").count() == 0
    check = rollup.split_check(held.where("split = 'train'"), held.where("split = 'test'"), [], "id").first()
    assert (check.n_leaked, check.n_duplicated, check.n_train, check.n_test) == (0, 0, 160, 40)


def test_validation_run(spark, tmp_path):
    df = spark.range(120).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("c"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("noise")
    )
    df = df.withColumn("x", F.when(F.col("id") > 3, F.col("x")))  # some values missing

    def fit_for(seed):
        return lambda train: learn.model_pipeline(["x", "noise"], learn.forest_classifier("y", trees=5, depth=3, seed=seed)).fit(train)

    scores, per_seed, summary = models.validate_classifier(df, fit_for, entity="id", label="y", cohort="c", seeds=(1, 2), folds=3)
    assert all(r.once and r.n_rows == 120 for r in learn.coverage(scores, "seed", "id").collect())
    assert {r.scope for r in per_seed.collect()} == {"all", "A", "B"}
    auc = {r.scope: r["mean"] for r in summary.where("metric = 'roc_auc'").collect()}
    assert auc["all"] > 0.9
    model = fit_for(1)(df)
    model.write().overwrite().save(f"{tmp_path}/m1")
    from pyspark.ml import PipelineModel

    stored = PipelineModel.load(f"{tmp_path}/m1")
    long = learn.ensemble_scores({1: stored, 2: fit_for(2)(df)}, df.select("noise", "id", "x"), "id", ["x", "noise"])
    assert long.count() == 240
    with pytest.raises(KeyError):
        learn.ensemble_scores({1: stored}, df.select("id", "x"), "id", ["x", "noise"])
    importance = {r.feature: r.importance_mean for r in learn.permutation_importance(df, model, "id", "y", ["x", "noise"], repeats=2).collect()}
    assert importance["x"] > 0.2 > importance["noise"]
    assert dict(learn.importances(model, ["x", "noise"]))["x"] > 0.5


def test_boxcox_lambda(spark):
    df = spark.range(1, 400).select(F.exp(F.randn(3) * 0.5).alias("y"))
    lam = learn.boxcox_lambda(df, [], "y").first()["lambda"]
    assert abs(lam) < 0.25
    squares = spark.range(1, 400).select(F.pow(F.randn(5) * 0.2 + 5, F.lit(2.0)).alias("y"))
    assert learn.boxcox_lambda(squares, [], "y", refine=1).first()["lambda"] == pytest.approx(0.5, abs=0.45)


def test_horizon_check(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "pass_n200 int, pass_n300 int")
    got = {r.horizon: (r.pass_rate, r.not_rising) for r in models.horizon_check(df, (200, 300)).collect()}
    assert got == {200: (1.0, None), 300: (0.5, True)}


def test_candidate_features(spark):
    """Logistic charge curves: the derivative peaks at the centre of each curve."""
    rows = []
    for cd, phase, centre, sign in ((1, "discharge", 3.70, -1.0), (5, "discharge", 3.68, -1.0), (5, "charge", 3.74, 1.0)):
        for i in range(1, 600):
            q = i / 600
            bend = 0.05 * math.log(q / (1 - q))
            rows.append(("a", cd, phase, q * 3600.0, sign, centre + sign * bend))
    samples = spark.createDataFrame(rows, "cell_name string, cd_index int, cd_phase string, step_time double, current double, voltage double")
    slices = spark.createDataFrame([("a", c, c) for c in (1, 3, 5)] + [("b", 1, 1)], "cell_name string, regular_cycle int, cd_index int")
    got = {r.cell_name: r for r in build.candidate_features(samples, slices).collect()}
    a = got["a"]
    assert a.dqdv_peak_v_c5_dis == pytest.approx(3.68, abs=0.003)
    assert a.dqdv_peak_v_shift_c1c5_dis == pytest.approx(-0.02, abs=0.004)
    assert a.dqdv_charge_discharge_hysteresis_c5 == pytest.approx(0.06, abs=0.004)
    assert 0.9 < a.dqdv_cosine_sim_c1c5_dis < 1.0
    assert a.dqv_norm_c5_c1_min < 0 and a.dqv_norm_c5_c1_var_log10 < 0
    assert got["b"].dqdv_peak_v_c5_dis is None


def test_indexed_samples_open_few_files(spark, tmp_path):
    rows = [(f"cell{k % 40:02d}" if k % 41 else None, k, k / 7) for k in range(4000)] + [("hot", k, 0.5) for k in range(4000)]
    df = spark.createDataFrame(rows, "cell_name string, t long, v double").repartition(5)
    written = writers.write_samples(df, str(tmp_path), "cell_name", ["t"], files=12)
    assert written == 12
    for names in (["cell07", "cell08", "none"], ["hot"], ["none"], ["cell00", "cell39", None]):
        wanted = spark.createDataFrame([(n,) for n in [*names, names[0]]], "cell_name string")
        got = readers.read_indexed_samples(spark, str(tmp_path), ["cell_name", "t", "v"], wanted, "cell_name", schema=df.schema)
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] is not None and r[0] in names)
        opened = [f for f in got.inputFiles() if "/samples/" in f]
        assert len(opened) <= (8 if "hot" in names else 3) and len(opened) < written
