"""Operators that need more than one expression: aggregations, windows, scoring, spatial joins, graphs, clusters, models."""
