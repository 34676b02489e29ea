"""Operators for building training corpora at scale.

Every operator maps DataFrames to DataFrames and picks the columns it needs by name, so
further columns, whatever they are called, never reach it.  Nothing outside this
subpackage imports it.
"""
