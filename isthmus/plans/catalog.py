"""All queries of the separability engine, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import continuous, discrete, online


def queries() -> dict:
    return discrete.queries() | continuous.queries() | online.queries()


def oracle_sql() -> dict[str, str]:
    return discrete.sql() | continuous.sql() | online.sql()
