"""Connected components, and complete groups from sorted streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.session import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (a, b) but each component's smallest: its component is the smallest node.

    Every round hangs each node's neighbours under the smallest of them, first the larger neighbours, then the smaller
    ones; when nothing changes, each node hangs under the smallest of its component. No round makes more edges than it
    reads and nothing is gathered by component, so large ones and nodes with many edges are no special case.
    """

    def larger_first(frame: DataFrame) -> DataFrame:
        return frame.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def written(frame: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a written table, with a mark of them that is taken while they are written."""
        seen = Observation()
        marked = frame.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark"))
        table = reliable_checkpoint(marked, "edges")
        return table, (seen.get["n"], seen.get["mark"])

    current, before = written(larger_first(edges))
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = larger_first(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        current, after = written(larger_first(small.unionByName(least.select("a", F.col("_m").alias("b")))))
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def whole_groups(frames: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Rows of each key from frames that are sorted by the keys. Holds the rows of one key at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        for key, part in frame.groupby(list(keys), sort=False, dropna=False):
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
