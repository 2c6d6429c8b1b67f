"""Operators of a training-data pipeline (sharding, deduplication, packing,
tokenizing, filtering). Nothing else in the library imports this package."""
