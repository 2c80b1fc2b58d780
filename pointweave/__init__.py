"""Spark-native operators for point-based scenes, their image evidence and their edits.

Operators are functions that take and return DataFrames; the session's optimizer
chooses the physical plan.  ``queries`` binds them to tables.
"""
