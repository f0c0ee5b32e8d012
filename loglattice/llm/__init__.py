"""Training-data operators: cleaning, deduplication, mixing, tokenising. Nothing else in the library imports this."""

from loglattice.llm.registry import QUERIES, SQL
from loglattice.llm import queries as _queries  # noqa: F401  fills the registry

__all__ = ["QUERIES", "SQL"]
