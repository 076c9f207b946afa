"""Operators for preparing training corpora at cluster scale.

Nothing else in the library imports this subpackage, so it can be removed
without touching the rest.
"""
