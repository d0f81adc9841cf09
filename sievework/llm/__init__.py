"""Operators for large text collections: extraction, filtering, deduplication, sharding and packing."""
