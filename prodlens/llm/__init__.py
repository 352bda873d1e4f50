"""Operators for preparing training data: filters, near-duplicates, scoring, packing, sharding."""
