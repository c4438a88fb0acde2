"""All named queries of the core engine and their SQL twins."""

from __future__ import annotations

from . import canary_queries, clean_queries, codec_queries, command_queries, fidelity_queries, file_queries, forensic_queries, wordmark_queries  # noqa: F401
from .query import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
