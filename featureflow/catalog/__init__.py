"""Checked queries, one per operator of the library."""

from featureflow.catalog import history, jobs, planted, relational, scalars, semantics  # noqa: F401
from featureflow.catalog.registry import ORACLES, QUERIES  # noqa: F401
