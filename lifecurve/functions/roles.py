"""Table schemas and column roles: which columns may reach a training matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Field names of the nested documents.
CYCLE_EVENT = T.StructType(
    [
        T.StructField("event_kind", T.StringType()),
        T.StructField("cd_index", T.IntegerType()),
        T.StructField("regular_cycle", T.IntegerType()),
        T.StructField("tester_cycle", T.IntegerType()),
        T.StructField("capacity_discharge_ah", T.DoubleType()),
        T.StructField("capacity_charge_ah", T.DoubleType()),
        T.StructField("coulombic_efficiency", T.DoubleType()),
    ]
)
RATE_REGIME = T.StructType(
    [T.StructField("n_regular_cd", T.IntegerType()), T.StructField("baseline_i_a", T.DoubleType())]
)
DOCUMENT = T.StructType(
    [
        T.StructField("cell_name", T.StringType()),
        T.StructField("cycling_consistency", T.StringType()),
        T.StructField("protocol_pattern", T.StringType()),
        T.StructField("cd_events", T.ArrayType(CYCLE_EVENT)),
        T.StructField("regular_rate_regimes", T.ArrayType(RATE_REGIME)),
    ]
)
DECISION = T.StructType(
    [
        T.StructField("exclude_from_ml", T.BooleanType()),
        T.StructField("last_available_cycle", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("validated_at", T.StringType()),
        T.StructField("n_regular_at_review", T.LongType()),
    ]
)
OUTLIER_ENTRY = T.StructType(
    [
        T.StructField("n_outliers", T.LongType()),
        T.StructField(
            "outliers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("cycle", T.LongType()), T.StructField("z_score", T.DoubleType())]
                )
            ),
        ),
    ]
)

# Output columns of the label and feature tables.
LABEL_META = ["cell_name", "cohort", "protocol_pattern", "cycling_consistency"]
LABEL_BASE = [
    "n_regular_pre_rate_change",
    "status",
    "exclusion_reason",
    "last_fade_cycle",
    "n_regular",
    "baseline_dis_ah",
    "final_retention",
    "n_recovered_crossings",
    "truncation_cycle",
    "n_outliers_masked",
]
TIER_A = [
    "coulombic_efficiency_final",
    "discharge_capacity_retention_final",
    "charge_capacity_retention_min",
]
TIER_B = [
    "discharge_nominal_voltage_retention_max",
    "discharge_nominal_voltage_retention_std",
    "charge_nominal_voltage_retention_max",
]
FIT_FIELDS = ["A_fast_frac", "tau_fast", "tau_slow", "beta", "tau_ratio"]
FIT_CYCLES = [3, 4, 5]
FIT_ENGINEERED = [
    "A_slow_to_fast_mean",
    "A_slow_to_fast_delta",
    "log_A_slow_to_fast_delta",
    "A_fast_frac_cv",
]
TIER_C = (
    [f"cv_{f}_c{c}" for f in FIT_FIELDS for c in FIT_CYCLES]
    + [f"cv_{f}_{a}" for f in FIT_FIELDS for a in ("mean", "std", "delta")]
    + FIT_ENGINEERED
)
FEATURES = TIER_A + TIER_B + TIER_C


def label_columns(horizons: Sequence[int] = (200, 300, 400)) -> list[str]:
    return LABEL_META + LABEL_BASE + [f"{p}_n{n}" for n in horizons for p in ("label", "trainable")]


def role_table(horizons: Sequence[int] = (200, 300, 400)) -> dict[str, str]:
    """Role of every emitted column: meta, label or feature."""
    roles = {c: "meta" for c in LABEL_META}
    roles |= {c: "label" for c in label_columns(horizons) if c not in LABEL_META}
    return roles | {c: "feature" for c in FEATURES}


def tier_of(name: str) -> str:
    """Tier by name: b = nominal voltage, a = efficiency or capacity retention, c = everything else."""
    if "nominal_voltage" in name:
        return "b"
    if "coulombic_efficiency" in name or "capacity_retention" in name:
        return "a"
    return "c"


def subset_columns(
    name: str, roles: Mapping[str, str], named: Mapping[str, Sequence[str]] | None = None
) -> list[str]:
    """Members of a feature subset. A named subset wins over the rule-based ones."""
    if named and name in named:
        return list(named[name])
    features = [c for c, role in roles.items() if role == "feature"]
    tiers = {
        "fs_all": "abc",
        "fs_a_only": "a",
        "fs_b_only": "b",
        "fs_c_only": "c",
        "fs_ab": "ab",
    }
    if name not in tiers:
        raise KeyError(f"unknown feature subset {name!r}")
    members = [c for t in tiers[name] for c in features if tier_of(c) == t] if name == "fs_ab" else [
        c for c in features if tier_of(c) in tiers[name]
    ]
    if not members:
        raise KeyError(f"feature subset {name!r} has no columns")
    return members


def training_matrix(
    df: DataFrame, keys: Sequence[str], wanted: Sequence[str], roles: Mapping[str, str]
) -> DataFrame:
    """Keys plus the wanted feature columns. Missing columns and non-feature columns are refused."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")
    leaking = [c for c in wanted if roles.get(c, "feature") != "feature" or c == "cohort"]
    if leaking:
        raise ValueError(f"not feature columns: {leaking}")
    return df.select(*keys, *wanted)


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Refuse a table whose columns drifted from the role table."""
    extra, missing = set(df.columns) - set(expected), set(expected) - set(df.columns)
    if extra or missing:
        raise ValueError(f"schema drift: unexpected {sorted(extra)}, missing {sorted(missing)}")
    return df.select(*expected)
