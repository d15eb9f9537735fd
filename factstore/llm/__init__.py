"""Operators for preparing training data, one module for each; ``queries`` registers them.

Nothing else in the library imports this subpackage.
"""
