"""Exact top-k search by inner product, term at a time.

The components of the vectors are terms. A block of candidates becomes one posting list for each term: positions and
weights other than 0. A query goes through its own terms and scatters query weight times posting weight into a dense
array of scores; its largest entries are selected by partition, and the blocks' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import in_blocks, usable

RESULT = "query_id bigint, vec_id bigint, score bigint"


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it and their weights."""
    out = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        out.append((rows, np.ascontiguousarray(column[rows])))
    return out


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> None:
    scores[:] = 0
    for term in np.flatnonzero(query):
        rows, weights = lists[term]
        if len(rows) == len(scores):
            scores += query[term] * weights
        else:
            scores[rows] += query[term] * weights


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int, own: int) -> np.ndarray:
    """Positions of the k highest scores of rows with another id; ties go to the smaller id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        least = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= least]
    order = np.lexsort((ids[places], -scores[places]))
    return places[order[:k]]


def _search(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        asked, matrix = np.stack(queries["vector"].to_numpy()), np.stack(candidates["vector"].to_numpy())
        reach = float(np.abs(asked.astype(np.float64)).max(initial=0)) * float(np.abs(matrix.astype(np.float64)).max(initial=0)) * matrix.shape[1]
        if reach >= 2.0**63:
            raise ValueError("a score may exceed 64 bits")
        lists, ids = postings(matrix), candidates["vec_id"].to_numpy()
        scores, found = np.zeros(len(ids), dtype=np.int64), []
        for own, query in zip(queries["vec_id"].to_numpy(), asked):
            accumulate(query, lists, scores)
            places = top_rows(scores, ids, k, own)
            found.append((np.full(len(places), own), ids[places], scores[places]))
        query_id, vec_id, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    return search


def merged(found: DataFrame, k: int, *order) -> DataFrame:
    """The first k of each query's rows, of which each block of candidates has given k at most; ranks from 1."""
    best = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose vec_id is divisible by ``every`` the k others with the
    largest inner product of ``floor(scale * component)``, in whole numbers.

    Null vectors, empty ones and those with null or non-finite components take no part; nor do rows without vec_id.
    Vectors of another length than the query's are no candidates. Repeated rows are asked once, and stand as often
    among the candidates as they occur; rows with the query's own vec_id never do. Fewer candidates than k give fewer
    rows. A score that could exceed 64 bits is an error.
    """
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    vectors = vectors.select("vec_id", F.transform("vector", lambda x: F.floor(x.cast("double") * float(scale)).cast("bigint")).alias("vector"))
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    left, right, keys = in_blocks(queries, vectors, "vec_id")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), RESULT)
    return merged(found, k, F.desc("score"), "vec_id")
