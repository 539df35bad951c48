"""Operators for preparing training corpora, one module each.

Nothing outside this package imports it.  Operators take and return
DataFrames; :mod:`.queries` binds them to the driver tables.
"""
