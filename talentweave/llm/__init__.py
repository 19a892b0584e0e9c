"""Operators for preparing training text: deduplication, search, filtering, mixing, formatting, tokenising.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this subpackage imports it.
"""
