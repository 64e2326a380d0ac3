"""Operators for training-data pipelines: tokenizing, search, deduplication, mixing, sharding."""
