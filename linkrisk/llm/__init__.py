"""Operators of a training-data pipeline, each a DataFrame-in, DataFrame-out function.

Nothing else in the library imports this subpackage.
"""
