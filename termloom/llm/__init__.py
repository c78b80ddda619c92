"""Training-data operators: sharding, packing, token counts, quality, PII, encoding, dedup, URL and toxicity filters.

Nothing outside this package imports it.
"""
