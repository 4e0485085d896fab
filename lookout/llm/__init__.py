"""Training-data operators: deduplication, quality, sharding, packing, privacy.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
