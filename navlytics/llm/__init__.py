"""Operators of a training-data pipeline: cleaning, de-duplication, tokens, packing, archives, retrieval."""
