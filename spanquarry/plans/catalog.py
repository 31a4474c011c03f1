"""The registered queries of the trace operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import compare_queries, ensemble_queries, metric_queries, rca_queries, rerank_queries, scenario_queries, selection_queries, source_queries, trace_queries, window_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "trace_points"
