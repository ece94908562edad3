"""Operators of a training-data pipeline: one module per operator.

Text operators take ``doc_id`` and ``text`` of a table; other columns are ignored
unless the operator's docstring names them.
"""
