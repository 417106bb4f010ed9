"""Operators that prepare text corpora for model training.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; the ``opN_*`` queries that apply them with production parameters are
in :mod:`libris.llm.queries`.
"""
