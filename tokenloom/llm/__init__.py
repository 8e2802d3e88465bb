"""Operators that a training-data pipeline needs, on DataFrames.

Nothing outside this subpackage imports it; it imports nothing of the rest of
``tokenloom`` either, so that both parts can be used alone.
"""
