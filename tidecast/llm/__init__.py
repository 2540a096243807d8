"""Operators of a training-data pipeline: extraction, filtering, deduplication, packing and scoring of text."""
