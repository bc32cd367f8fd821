"""Operators for training-data pipelines over the text tables.

Nothing else in the library imports this package; ``queries`` maps each
query name to its function and ``oracle`` holds the SQL twins.
"""
