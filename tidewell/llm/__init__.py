"""Operators for preparing training data: quality, sharding, privacy, encoding, deduplication.

Nothing outside this subpackage imports it; ``catalog`` lists its queries.
"""
