"""All registered queries of the core."""

from __future__ import annotations

from . import marts, pairs, rows, runs, scores  # noqa: F401 - importing registers them
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
