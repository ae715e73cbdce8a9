"""Operators for training-data pipelines: one module per operator, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
