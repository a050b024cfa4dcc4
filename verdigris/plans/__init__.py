"""Registered queries, one for each operator, with their SQL."""

from verdigris.plans import aggs, folds, joins, scalars, sources, streams, workflow
from verdigris.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggs", "folds", "joins", "scalars", "sources", "streams", "workflow"]
