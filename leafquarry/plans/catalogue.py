"""Imports every module of queries, so that the registry is complete."""

from leafquarry.plans import ingest, over_tables, records, relational, retrieval, scalars  # noqa: F401
from leafquarry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
