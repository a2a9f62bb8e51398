"""Operators of a training-data pipeline: filtering, deduplication, scoring, mixing."""
