"""All queries of the library and their SQL."""

from quillstone.plans import relational, retrieval, scalar, serving, upkeep  # noqa: F401
from quillstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
