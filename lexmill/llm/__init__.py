"""Operators of a training-data pipeline over document corpora.

Nothing else in the library imports this subpackage. Every operator keeps its own general interface;
the thin ``opN_<name>`` queries in :mod:`lexmill.llm.queries` derive their digest columns from them.
"""
