"""Registered queries over the fixture tables, and the SQL that gives the same rows."""

from tidemark.plans import analysis, evaluation, ingestion  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
