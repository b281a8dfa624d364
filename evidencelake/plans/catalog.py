"""All registered queries with their DuckDB oracles."""

from __future__ import annotations

from evidencelake.plans import graphs, planning, relational, remaining, reporting, retrieval, structure, understanding, whole  # noqa: F401
from evidencelake.plans.registry import ORACLES, QUERIES  # noqa: F401
