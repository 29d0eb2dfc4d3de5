"""Registered queries: each a DataFrame over the given tables, with its SQL twin."""

from . import registry
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries", "registry"]
