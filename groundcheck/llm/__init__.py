"""Text-corpus operators: search, sharding, near duplicates, scoring, mixing and packing.

They work on the review log: one row per review event with its ``event_id`` and free ``notes``.
"""
