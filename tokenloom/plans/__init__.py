"""Whole tokenizers as plans over DataFrames."""
