"""Operators of a training-data pipeline; each dealt operator is one module."""
