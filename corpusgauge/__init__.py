"""Corpus quality and experiment analytics as plain Spark jobs.

Operators are functions from DataFrame to DataFrame that take column names, so
the same operator runs on any table.  ``queries`` binds every operator to the
driver tables and pairs it with an independent SQL statement.
"""
