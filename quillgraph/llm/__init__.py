"""Training-data operators: deduplication, scoring, extraction, sharding, packing.

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
