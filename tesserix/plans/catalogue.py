"""All registered queries of the reference operators."""

from __future__ import annotations

from tesserix.plans import base, data_queries, more_queries, other_queries, score_queries  # noqa: F401  registering

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
