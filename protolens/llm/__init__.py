"""Operators for large-scale training-data pipelines, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
