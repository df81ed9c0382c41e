"""Operators that prepare training text: cleaning, deduplication, scoring, formatting, packing.

Nothing else in the library imports this subpackage.
"""
