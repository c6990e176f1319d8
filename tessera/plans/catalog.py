"""All queries over the driver tables, and their SQL."""

from __future__ import annotations

from . import code, curated, evaluation, localisation, records, rollouts, streams, summarised, texts, tokens  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
