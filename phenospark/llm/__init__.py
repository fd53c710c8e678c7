"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it. ``queries.py`` registers one thin
query for each operator; the operators themselves keep general interfaces.
"""
