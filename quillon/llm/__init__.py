"""Operators of a training-data pipeline: filtering, deduplication, sharding, mixing, tokenising, web archives."""
