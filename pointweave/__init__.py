"""Categorical point-set analytics on Spark."""
