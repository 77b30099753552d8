"""Named queries over the driver's tables: QUERIES, and ORACLES in SQL."""

from recall_engine.plans import boards, documents, pages, queries, workspace  # noqa: F401  (they register)
from recall_engine.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
