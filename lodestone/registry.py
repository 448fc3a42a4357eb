"""Queries by name and their SQL."""

from lodestone.plans.oracles import ORACLE_SQL
from lodestone.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
