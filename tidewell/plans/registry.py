"""Every registered query and its SQL, apart from those of the subpackage llm."""

from __future__ import annotations

from . import consistency_queries, craft_queries, memory_queries, operator_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "recall_fused"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
