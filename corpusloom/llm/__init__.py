"""Training-data operators: formatting, filtering, deduplication, packing, archives.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
