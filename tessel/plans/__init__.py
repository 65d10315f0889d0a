"""Execution patterns: one aggregation for each training step, queries against all rows in blocks."""
