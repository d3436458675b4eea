"""All queries of the engine with their oracles."""

from __future__ import annotations

from motionweave.plans import adapters, matrices, signals, statistics  # noqa: F401  (they register)

QUERIES = adapters.QUERIES
SQL = adapters.SQL
