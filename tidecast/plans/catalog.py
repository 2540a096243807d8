"""Imports every module that registers queries."""

from tidecast.plans import model_queries, relational  # noqa: F401
from tidecast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
