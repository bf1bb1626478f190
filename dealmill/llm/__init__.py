"""Operators of a training-data pipeline: formatting, dedup, counting, filtering, mixing, search.

Nothing outside this subpackage imports it.
"""
