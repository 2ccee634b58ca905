"""Imports every query module, so that the registry is complete."""

from provloom.plans import graph_queries, job_queries, label_queries, match_queries, reduce_queries, source_queries, text_queries  # noqa: F401
from provloom.plans.registry import ORACLES, QUERIES  # noqa: F401
