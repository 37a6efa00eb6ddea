"""Training-data operators: deduplication, mixing, sharding, archives, tokenizing, scoring and fingerprints.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
