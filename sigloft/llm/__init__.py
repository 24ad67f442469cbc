"""Operators of a training-data pipeline over text tables, with their registered queries."""
