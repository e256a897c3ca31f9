"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each module holds one operator with a
general interface over DataFrames; ``registry`` derives the registered queries
from them.
"""
