"""All registered queries and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from .plans.queries import queries as found
    return found()


def oracle_sql() -> dict[str, str]:
    from .plans.oracles import SQL
    return {k: v for k, v in SQL.items() if k in queries()}
