"""Every registered query of the knowledge-graph engine with its SQL statement."""

from __future__ import annotations

from quarrygraph.plans import answering, queries, scoring  # noqa: F401  (they register themselves)
from quarrygraph.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
