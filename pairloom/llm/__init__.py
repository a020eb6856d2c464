"""Operators that prepare training data from a track catalogue's texts and vectors.

Nothing else in the library imports this subpackage.
"""
