"""All registered queries."""

from __future__ import annotations

from clickloom.plans import data, evaluation, features, learning, linear, streams, training  # noqa: F401
from clickloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
