"""Named queries over the driver tables, one module per group."""

from lifecurve.queries import audits, curve_queries, front_door, label_stack, learning, reports, rollups, scoring, series  # noqa: F401
from lifecurve.queries.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
