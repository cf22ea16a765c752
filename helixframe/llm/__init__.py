"""Operators of a training-data pipeline: scans, filters, deduplication, joins, mixing, formatting and packing."""
