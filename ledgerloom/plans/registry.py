"""The registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: list[str] | None = None):
    """Register a query; ``views`` are the table expressions the SQL builds on."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            body = sql.strip()
            head = "WITH " + ",\n".join(views) if views else ""
            # a query with table expressions of its own starts with a comma or with WITH
            CHECKS[name] = f"{head}\n{body}" if head else body
        return function

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Computed doubles to a fixed number of places, so that two engines can be compared. Plain arithmetic,
    because engines treat halves differently in ``round``."""
    scale = float(10**places)

    def fix(name: str):
        value = F.col(name).cast("double")
        return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale

    return df.withColumns({c: fix(c) for c in columns})
