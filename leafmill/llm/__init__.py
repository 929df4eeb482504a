"""Operators for large text corpora used to train language models.

Every operator takes and returns DataFrames.  Nothing outside this package imports it.
"""
