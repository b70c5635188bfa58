"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from tidemark.plans import q_analysis, q_metrics, q_raster, q_report, q_timeseries, q_vector

MODULES = (q_timeseries, q_raster, q_vector, q_metrics, q_report, q_analysis)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
