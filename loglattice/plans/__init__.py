"""Registered queries: named compositions of the operators over the given tables."""

from loglattice.plans import q_catalog, q_events, q_faults, q_parse, q_text  # noqa: F401
from loglattice.plans.registry import QUERIES, SQL  # noqa: F401
