"""Imports every module that registers queries."""

from tidemark.plans import landing, quality, reading, rules, study  # noqa: F401
from tidemark.plans.registry import CHECKS, COVERS, QUERIES

__all__ = ["CHECKS", "COVERS", "QUERIES"]
