"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` registers them.  Nothing else in
the library imports this subpackage.
"""
