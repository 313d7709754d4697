"""All registered queries of the terminology engine and their DuckDB oracles."""

from __future__ import annotations

from .plans import composite, parts, relational, retrieval

QUERIES = retrieval.QUERIES | relational.QUERIES | composite.QUERIES | parts.QUERIES
ORACLES = retrieval.ORACLES | relational.ORACLES | composite.ORACLES | parts.ORACLES
