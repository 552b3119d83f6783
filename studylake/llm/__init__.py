"""Operators for large text corpora, each a small module over DataFrames."""
