"""Pipelines as graphs of named datasets, their context, resilience, lineage and metrics."""
