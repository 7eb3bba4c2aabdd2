"""Every query of the inventory, by name, and the SQL it is checked against."""

from . import functions, patterns, pipelines, relational, sources, streams, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
