"""Registered queries with their reference SQL."""

from sevfold.queries import metrics, models, relational, results, sources, splits, stats, text, vectors  # noqa: F401
from sevfold.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
