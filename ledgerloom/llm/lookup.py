"""Joins with short lists of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LIMIT = 2_000_000  # rows of whole numbers that are sent to the tasks; a longer list is joined by a shuffle


def with_list(table: DataFrame, short: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``table`` joined with ``short`` on doc_id; the other columns of ``short`` are bigint.

    Rows of ``table`` can be large. When ``short`` has few rows, the tasks get it as sorted arrays and look each doc_id up
    where its row is, so that no large row moves that is not wanted. Otherwise it is an ordinary join with the same rows.
    """
    names = [c for c in short.columns if c != "doc_id"]
    if table.schema["doc_id"].dataType.simpleString() != "bigint" or short.count() > limit:
        return table.join(short, "doc_id")
    lists = short.where("doc_id IS NOT NULL").toArrow()
    ids = lists["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    sent = table.sparkSession.sparkContext.broadcast((ids[order], [lists[c].to_numpy()[order] for c in names]))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, columns = sent.value
        for frame in frames:
            own = frame["doc_id"].to_numpy()
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            times = high - low
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            found = frame.iloc[np.repeat(np.arange(len(frame)), times)]
            yield found.assign(**{n: c[at] for n, c in zip(names, columns)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.where("doc_id IS NOT NULL").mapInPandas(look_up, ", ".join([kinds, *[f"`{n}` bigint" for n in names]]))
