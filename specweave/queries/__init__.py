"""The registered queries of the engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from specweave.queries import graph, review, text

flagship = graph.flagship


def queries() -> dict:
    return graph.QUERIES | review.QUERIES | text.QUERIES


def oracle_sql() -> dict[str, str]:
    return graph.SQL | review.SQL | text.SQL
