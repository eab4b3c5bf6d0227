"""Operators for building training corpora: deduplication, scoring, mixing, sharding, tokens and filters.

Nothing outside this subpackage imports it.
"""
