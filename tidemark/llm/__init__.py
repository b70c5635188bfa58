"""Operators of a training-data pipeline: sharding, filters, deduplication, tokens, chat threads and packing."""
