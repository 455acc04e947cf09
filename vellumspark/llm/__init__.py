"""Operators for preparing text corpora: one module each, with their queries in ``catalog``.

Nothing else in the library imports this subpackage.
"""
