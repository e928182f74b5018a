"""Operators of a large-scale text preparation pipeline.

Nothing else in the library imports this package; it can be removed whole.
"""
