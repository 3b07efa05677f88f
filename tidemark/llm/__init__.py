"""Operators of a training-data pipeline: scoring, redaction, decontamination, sharding, deduplication, packing and files.

Nothing else in the package imports this subpackage.
"""
