"""All queries of the engine, with SQL for those that SQL can express."""

from __future__ import annotations

from .plans import catalogue, catalogue_analyses  # noqa: F401  the second adds to the first

QUERIES = dict(catalogue.QUERIES)
ORACLES = dict(catalogue.ORACLES)
