"""Operators of a training-data pipeline: filters, classifiers, deduplication, extraction and mixing."""
