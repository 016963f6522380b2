"""Operators of a training-data pipeline: deduplication, decontamination, scans, language ID, tokenizing.

Nothing else in the library imports this subpackage; the folder can be removed as a whole.
"""
