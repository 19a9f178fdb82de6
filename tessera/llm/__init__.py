"""Operators for preparing large language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and can be used on its own; ``queries.py`` registers the thin
``opN_<name>`` queries.
"""
