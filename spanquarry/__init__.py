"""Trace analytics on Spark: spans to traces, window features, budgeted sampling, root-cause ranking and scoring."""
