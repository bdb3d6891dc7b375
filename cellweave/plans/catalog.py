"""Imports every query module so that the registry is full."""

from cellweave.plans import graph_queries, interp_queries, kg_queries, model_queries, panel_queries, source_queries, spatial_queries, vector_queries  # noqa: F401
from cellweave.plans.registry import ORACLES, QUERIES  # noqa: F401
