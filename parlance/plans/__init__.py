"""Queries of the library, registered by the modules imported here."""

from parlance.plans import aggregates, ingestion, joins, predicates, retrieval, rules, scalars, streams  # noqa: F401
from parlance.plans.registry import ORACLES, QUERIES  # noqa: F401
