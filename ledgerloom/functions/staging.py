"""Staging of costly expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """Append costly columns, or fix the ones there are, so that they are computed once per row.

    A filter on a plain computed column is pushed below its projection together with a copy of the
    expression. Going through ``inline`` keeps it above, so the filter tests the finished value.
    """
    columns = columns or {}
    fields = [F.col(c) for c in df.columns if c not in columns] + [c.alias(n) for n, c in columns.items()]
    return df.select(F.inline(F.array(F.struct(*fields))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` names it.

    For a value that is needed on some rows only, where ``evaluate_once`` would compute it on all. A column expression
    that is named twice is otherwise computed twice inside a CASE."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
