"""All queries over the driver's tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

from . import code_queries, graph_queries, report_queries, score_queries, text_queries  # noqa: F401  each module signs its queries in
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
