"""All catalog queries and their DuckDB oracles, by name."""

from __future__ import annotations

from gradelens.plans import breakdowns, dashboards, enrichment, etl, modeling, selections, storage  # noqa: F401  (register queries)
from gradelens.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
