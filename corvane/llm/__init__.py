"""Training-data operators: search, deduplication, scoring, archives, tokens and packing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
