"""What both vector searches use: valid vectors and blocks of queries against blocks of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 4096  # about so many queries meet
CANDIDATE_BLOCK = 16384  # about so many candidates in one task


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty, and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def in_blocks(queries: DataFrame, candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with columns ``_width, _q, _c`` by which groups are paired: every query meets every candidate of its
    width exactly once. Blocks have a bounded number of rows, and each row is repeated once for each block of the other side."""
    n_q = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    n_c = max(1, math.ceil(candidates.count() / CANDIDATE_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    width = F.size("vector").alias("_width")
    # new names for the same values, because both sides may come from one table
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    left = queries.select("*", width, block(n_q).alias("_q")).select("*", every(n_c).alias("_c"))
    right = candidates.select("*", width, block(n_c).alias("_c")).select("*", every(n_q).alias("_q"))
    return left, right, ["_width", "_q", "_c"]
