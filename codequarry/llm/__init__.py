"""Operators of a training-data pipeline: scoring, deduplication, decontamination, packing,
formatting and extraction. Nothing outside this package imports it."""
