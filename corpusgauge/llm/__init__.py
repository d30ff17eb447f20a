"""Operators of a training-data pipeline; nothing else in the package imports them.

``queries.QUERIES`` binds one query to each operator, with its SQL where SQL can
say it.
"""
