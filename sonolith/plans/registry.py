"""All queries of the library by name."""

from __future__ import annotations

from . import features, kernels, models, signals, tables  # noqa: F401  (they register their queries)
from .common import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
