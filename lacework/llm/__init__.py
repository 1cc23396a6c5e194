"""Operators for large training-data pipelines: tokens, mixing, scans, deduplication and quality."""
