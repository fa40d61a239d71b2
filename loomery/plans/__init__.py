"""Named queries over the driver tables, each with the SQL that it must equal."""

from __future__ import annotations

from loomery.plans import inventory_queries, profile_queries, sequence_queries, source_queries, summary_queries, table_queries
from loomery.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "inventory_queries", "profile_queries", "sequence_queries", "source_queries", "summary_queries", "table_queries"]
