"""Operators of a training-data pipeline: scans, deduplication, mixing, language, scoring."""
