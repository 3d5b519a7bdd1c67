"""Training-data operators: filtering, deduplication, decontamination, mixing and extraction.

Nothing outside this subpackage imports it.
"""
