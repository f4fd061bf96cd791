"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from repolith.plans import code, graphs, joins, lifecycle, scalars, streams, vectors  # noqa: F401  each registers its queries
from repolith.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
