"""Operators of a training-data pipeline over a documents table.

Each operator has its own module and a general interface; :mod:`.queries` holds the thin
registered queries. Nothing else in the library imports this subpackage.
"""
