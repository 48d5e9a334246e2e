"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator ID, and
for most of them an independent DuckDB SQL oracle over the same driver tables."""

from __future__ import annotations

from .common import QUERIES, SQL  # noqa: F401
from . import q_sources, q_audit, q_prep, q_logs, q_joins, q_plan, q_stream  # noqa: F401,E402


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
