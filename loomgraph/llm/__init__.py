"""Operators for training-data pipelines: search, decontamination, formatting, deduplication, extraction, filters."""
