"""Shared inputs of the queries: the event table read as life curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.operators.ordered import Ordered
from lifecurve.operators.series import number_cycles, with_retention
from lifecurve.queries.registry import Tables

HORIZONS = (50, 60, 70)

# SQL twin of ``cycles``: user = entity, cycle = position in time.
CYC = """
cyc AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cycle,
         value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, event_id
  FROM events)
"""

# SQL twin of ``retentions``: baseline at the first cycle.
RET = (
    CYC
    + """,
base AS (SELECT user_id, value AS baseline FROM cyc WHERE cycle = 1),
ret AS (SELECT c.*, b.baseline, CASE WHEN b.baseline > 0 THEN c.value / b.baseline END AS retention
        FROM cyc c JOIN base b USING (user_id))
"""
)


def event_rows(t: Tables, *extra: str) -> DataFrame:
    """Events with the JSON payload as a column when asked for."""
    df = t.events
    if "k" in extra:
        df = df.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return df.select("user_id", "ts", "event_id", "value", *extra)


def cycles(t: Tables, *extra: str) -> Ordered:
    return number_cycles(event_rows(t, *extra), "user_id", ["ts", "event_id"], bound=t.rows("events"))


def retentions(t: Tables, *extra: str) -> Ordered:
    return with_retention(cycles(t, *extra), "value", "cycle", baseline_cycle=1)


def r6(col, name: str):
    """Round to the precision both engines agree on."""
    return F.round(col, 6).alias(name)
