"""Training-data operators: filtering, deduplication, search, packing and output formats.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
