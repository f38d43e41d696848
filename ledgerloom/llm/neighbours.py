"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

Each vector is padded to ``BITS`` components, rotated by one random orthogonal matrix and kept as signs, with its length
and the inner product of its direction with its own code. From these a query's inner product with the vector is
estimated, with a bound on the error that holds with high probability. Vectors whose upper bound reaches the k-th
largest lower bound are scored again on the original components.

Every row is coded and every code is compared with every query; nothing is sampled, and the rotation is not trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.exact_search import merged
from ledgerloom.llm.vectors import in_blocks, usable

BITS = 256
BOUND = 1.9  # standard deviations of the estimate that the bound allows for
INDEX = "vec_id bigint, vector array<double>, code binary, length double, fit double"
RESULT = "query_id bigint, vec_id bigint, score double, rescored int"


def code_bits(width: int) -> int:
    """Bits of a code: BITS, or the next multiple of 64 for longer vectors."""
    return max(BITS, -(-width // 64) * 64)


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """The first ``width`` columns of a random orthogonal matrix, the same in every task."""
    bits = code_bits(width)
    normal = np.random.Generator(np.random.PCG64([7, bits])).standard_normal((bits, width))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def encode(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of each direction with its code."""
    turned = matrix @ rotation(matrix.shape[1]).T
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / length
    return np.packbits(turned >= 0, axis=1), length, fit


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for width, part in frame.groupby(frame["vector"].map(len)):
            code, length, fit = encode(np.stack(part["vector"].to_numpy()))
            yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "vector": part["vector"].to_numpy(), "code": [c.tobytes() for c in code], "length": length, "fit": fit})


def build_index(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector, code, length, fit`` of every usable row: not null, not empty, not zero, all components finite."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    return rows.where(F.exists("vector", lambda x: x != 0)).mapInPandas(_index, INDEX)


def _search(k: int, bound: float):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "rescored": []}).astype({"query_id": "int64", "vec_id": "int64", "rescored": "int32"})
        matrix, ids = np.stack(candidates["vector"].to_numpy()), candidates["vec_id"].to_numpy()
        asked, own = np.stack(queries["vector"].to_numpy()), queries["vec_id"].to_numpy()
        bits = code_bits(matrix.shape[1])
        packed = np.stack([np.frombuffer(c, dtype=np.uint8) for c in candidates["code"]])
        signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
        length, fit = candidates["length"].to_numpy(), candidates["fit"].to_numpy()
        scale = length / (fit * np.sqrt(bits))
        spread = bound * length * np.sqrt(np.maximum(1 - fit**2, 0)) / (fit * np.sqrt(max(bits - 1, 1)))
        turned = (asked @ rotation(matrix.shape[1]).T).astype(np.float32)
        lengths = np.sqrt(np.einsum("ij,ij->i", asked, asked))
        found = []
        for start in range(0, len(own), 256):  # a bounded part of the table of estimates at a time
            estimates = signs @ turned[start : start + 256].T
            for j in range(estimates.shape[1]):
                i = start + j
                estimate, error = estimates[:, j] * scale, spread * lengths[i]
                others = np.flatnonzero(ids != own[i])
                if len(others) > k:
                    low = (estimate - error)[others]
                    least = np.partition(low, len(low) - k)[len(low) - k]
                    others = others[(estimate + error)[others] >= least]
                score = (matrix[others] * asked[i]).sum(axis=1)
                order = np.lexsort((ids[others], -score))[:k]
                found.append((np.full(len(order), own[i]), ids[others[order]], score[order], np.full(len(order), len(others), np.int32)))
        query_id, vec_id, score, rescored = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score, "rescored": rescored})

    return search


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, bound: float = BOUND) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose vec_id is divisible by ``every`` the k nearest others found.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Zero vectors, null or empty ones
    and those with null or non-finite components take no part, nor do rows without vec_id. Vectors of another length
    than the query's are no candidates. Repeated rows are asked once, and stand as often among the candidates as they
    occur; rows with the query's own vec_id never do. Fewer candidates than k give fewer rows.
    """
    index = build_index(embeddings)
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select("vec_id", "vector")
    left, right, keys = in_blocks(queries, index, "vec_id")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k, bound), RESULT)
    return merged(found, k, F.desc("score"), "vec_id")
