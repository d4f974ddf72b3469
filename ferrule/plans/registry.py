"""Registered queries: name to (spark, sf_dir) -> DataFrame, and name to DuckDB SQL."""

from . import catalogue, changes, entities, lookups, site, upkeep  # noqa: F401  (they add their queries)
from .queries import FLAGSHIP, QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
