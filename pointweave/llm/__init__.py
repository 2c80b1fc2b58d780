"""Operators for large training-data pipelines, independent of the rest of the library.

Every operator is an ordinary function over DataFrames; ``registry`` binds them
to the driver's tables.  Nothing outside this package imports it.
"""
