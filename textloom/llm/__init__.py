"""Training-data operators: filtering, deduplication, extraction, search, tokens and mixing.

Nothing outside this subpackage imports it.
"""
