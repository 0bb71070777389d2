"""Composed pipelines (Q1-Q7) and the registered query catalog."""
