"""All registered queries."""

from textreg.queries import columns, files, flows, guards, modelling, relational, text_features  # noqa: F401
from textreg.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
