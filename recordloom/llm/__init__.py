"""Operators for training-data pipelines: dedup, packing, tokens, shards, mixing, privacy, toxicity.

Nothing else in the package imports this folder.
"""
