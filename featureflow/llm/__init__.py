"""Operators of a training-data pipeline and their checked queries."""
