"""Operators for preparing language-model training data.

Each module is one operator with a general interface (DataFrames in,
DataFrames out, parameters with documented bounds); ``queries.py`` registers
the thin ``opN_*`` queries over the given tables. Nothing else in the library
imports this subpackage.
"""
