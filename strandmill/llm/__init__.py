"""Operators for training-data pipelines: tokenising, search, filtering, near duplicates, PII and packing.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
