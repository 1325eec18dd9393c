"""Declarative feature pipelines as Spark plans."""

__version__ = "0.1.0"
