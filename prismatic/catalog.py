"""All queries of the catalog and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import aggregates, delivery, evidence, imaging, joins, matches, policies, predicates, scalars, sequences, states, transport  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES  # noqa: F401
