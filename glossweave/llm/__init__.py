"""Operators for building training data from large text corpora.

Each module holds one operator over DataFrames; ``queries`` applies them to the given tables.
"""
