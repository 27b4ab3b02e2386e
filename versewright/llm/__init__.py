"""Operators for large text corpora.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` registers the thin
``opN_*`` queries that apply them to whole tables.
"""
