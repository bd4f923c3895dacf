"""Operators for training-data pipelines: text extraction, deduplication, counting, mixing and packing."""
