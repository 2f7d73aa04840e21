"""Structured Streaming jobs over the review-event log."""
