"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``queries.QUERIES`` holds the registered queries and ``queries.ORACLE_SQL`` their SQL.
"""
