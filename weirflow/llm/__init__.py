"""Operators for training-data pipelines: archives, deduplication, tokens, models."""
