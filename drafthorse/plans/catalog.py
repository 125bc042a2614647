"""All queries of the core package and the SQL that says the same."""

from __future__ import annotations

from . import detail_queries, engine_queries, more_queries, page_queries, state_queries, stream_queries, vote_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "j02_zero_miss_split"
