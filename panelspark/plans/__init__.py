"""Queries over the supplied tables and their SQL statements of the same result."""

from __future__ import annotations

from panelspark.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from panelspark.plans import (  # noqa: F401
        metric_queries,
        pair_queries,
        panel_queries,
        source_queries,
        squad_queries,
    )

    return QUERIES
