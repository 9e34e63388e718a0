"""Training-data operators: de-duplication, search, extraction, scoring, sharding, packing, encoding.

Nothing outside this package imports it; `registry` lists its queries.
"""
