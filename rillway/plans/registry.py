"""All queries on rivers, catalogs, basins and terrain by name, with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["river_queries", "catalog_queries", "terrain_queries", "course_queries", "mosaic_queries", "overlay_queries", "fork_queries"]


def _all() -> dict:
    return {name: pair for m in _MODULES for name, pair in import_module(f"rillway.plans.{m}").QUERIES.items()}


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
