"""All registered queries of the lending operators."""

from __future__ import annotations

from . import blocks, collateral, governance, monitoring, packs, portfolio, quality  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
