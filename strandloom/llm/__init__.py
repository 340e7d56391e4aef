"""Training-data operators: deduplication, filtering, mixing and binary formats.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
