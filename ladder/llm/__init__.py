"""Operators for preparing training text on Spark: one module per operator, ``queries`` registers them.

Nothing else in the library imports this package.
"""
