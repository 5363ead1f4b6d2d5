"""Importing this module registers every query."""

from shardflow.plans import queries_files, queries_metrics, queries_order, queries_samples, queries_snapshots, queries_tar  # noqa: F401
from shardflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
