"""Operators of a training-data pipeline: dedup, scoring, mixing, packing, private data.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` binds the operators to the tables.
"""
