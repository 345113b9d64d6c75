"""Operators of a training-data pipeline: URL and text filters, deduplication, mixing, sharding and token files."""
