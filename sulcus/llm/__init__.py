"""Operators for preparing large text corpora.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
