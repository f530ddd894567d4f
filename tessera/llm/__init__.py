"""Operators for preparing training data: sharding, deduplication, packing, scans, extraction."""
