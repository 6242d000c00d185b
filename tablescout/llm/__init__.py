"""Operators for training-data pipelines: deduplication, quality, packing, language and mixing."""
