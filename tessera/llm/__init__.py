"""Training-data operators: formatting, filtering, deduplication, search, packing.

Nothing else in the library imports this subpackage.
"""
