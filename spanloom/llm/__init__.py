"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage. Each operator module holds one
operator with its own general interface; ``queries`` holds the registered queries.
"""
