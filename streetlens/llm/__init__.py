"""Operators of a training-data pipeline: search, sharding, mixing, tokens,
near-duplicates, filters, extraction, fingerprints and licence scans.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
