"""Queries over the driver's tables, with the SQL that gives the same rows."""

from . import evidence_queries, lineage_queries, text_queries  # noqa: F401  they register themselves
from ._registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "ics_summary"
