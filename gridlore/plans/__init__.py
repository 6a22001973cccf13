"""Registered queries, one module per area; importing this package registers all of them."""

from gridlore.plans import files, profiling, questions, relational, retrieval, scoring  # noqa: F401
from gridlore.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
