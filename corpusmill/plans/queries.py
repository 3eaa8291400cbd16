"""All queries of the library's operators, and their SQL."""

from __future__ import annotations

from . import analysis, projects, scans, store  # noqa: F401
from .base import QUERIES, SQL


def entry(spark, sf_dir):
    return scans.entry(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
