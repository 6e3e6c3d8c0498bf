"""Registered queries and their DuckDB twins."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of every raster operator."""
    from . import queries, queries_regions, queries_shapes  # noqa: F401  (each module registers its own)

    return queries.QUERIES, queries.ORACLES
