"""Kelpline: curation of changing listings and document collections on Spark DataFrames."""
