"""Operators for training-data pipelines: dedup, classifiers, tokenising, extraction, packing, formatting, sharding.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
