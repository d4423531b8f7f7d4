"""Named queries over the driver's tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

FLAGSHIP = "probamap_detect"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
