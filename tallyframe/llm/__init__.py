"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage. Each operator is one module with a
general interface; ``queries`` holds the thin registered queries over the given tables.
"""
