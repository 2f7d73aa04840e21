"""Reusable DataFrame operators: spatial joins, measures, scores, rasters."""
