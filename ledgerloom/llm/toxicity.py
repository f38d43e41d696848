"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its lower-cased words and their first four, five and six letters, each hashed to ``BUCKETS``;
a term that occurs twice, and one that occurs more often, is a term of its own besides. The model has a weight and a
vector of ``RANK`` numbers for each bucket; a document's value is the bias, the sum of its weights and the sum of the
inner products of all pairs of its vectors, so that two terms can count together what neither counts alone.

The model is fitted on the driver with at most ``SAMPLE`` labelled documents of each class (documented bound); scoring
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.language import folded

BUCKETS = 1 << 20
RANK = 4
SAMPLE = 3000  # labelled documents of each class
MIN_DOCUMENTS = 4  # of the sample that have a bucket, for the bucket to count
MIN_CONTRAST = 3.0  # standard errors by which the classes' shares of documents with a bucket differ at least
STEMS = (4, 5, 6)
CHUNK = 1 << 20  # letters that are hashed together
_AGAIN = (0x5BD1E, 0xA3C59)  # added to the bucket of a term that occurs twice, and three times or more
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and stems in texts of lower-case letters and zeros, and the text of each."""
    joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint32))])
    letter = joined != 0
    begins = np.flatnonzero(letter & ~np.concatenate((np.zeros(1, bool), letter[:-1])))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.flatnonzero(letter & ~np.concatenate((letter[1:], np.zeros(1, bool)))) + 1 - begins
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
    place = np.arange(len(joined)) - np.repeat(np.append(0, begins), np.diff(np.concatenate(([0], begins, [len(joined)]))))
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, dtype=np.uint64))
    values = np.zeros(len(joined), dtype=np.uint64)
    values[letter] = _mixed(joined[letter].astype(np.uint64) + np.uint64(1)) * powers[place[letter]]
    words = np.add.reduceat(values, begins)
    out = [(words, row)]
    for size in STEMS:
        long = np.flatnonzero(sizes > size)
        stem = sum(values[begins[long] + i] for i in range(size)) + np.uint64(size)
        out.append((stem, row[long]))
    buckets = [(_mixed(h) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1) for h, _ in out]
    return np.concatenate(buckets), np.concatenate([r for _, r in out])


def terms_of(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and the text of each, by text. ``known``: the buckets that are of interest."""
    found, part, size = [], [], 0
    if known is not None:  # a term that occurs again counts under another bucket
        asked = known | np.roll(known, -_AGAIN[0]) | np.roll(known, -_AGAIN[1])
    for i, text in enumerate(texts):
        part.append(folded(text or ""))
        size += len(part[-1])
        if size < CHUNK and i + 1 < len(texts):
            continue
        buckets, rows = _hashed(part)
        if known is not None:
            buckets, rows = buckets[asked[buckets]], rows[asked[buckets]]
        keys = np.sort((rows + i + 1 - len(part)) * BUCKETS + buckets)
        keys, total = np.unique(keys, return_counts=True)
        rows = keys // BUCKETS * BUCKETS
        found.append(keys)
        found.extend(rows[total >= n] + (keys[total >= n] + add) % BUCKETS for n, add in zip((2, 3), _AGAIN))
        part, size = [], 0
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if known is not None:
        pairs = pairs[known[pairs % BUCKETS]]
    return pairs % BUCKETS, pairs // BUCKETS


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


class Model:
    """Weights ``w`` and vectors ``v`` by bucket; buckets that were not learned have zeros."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def values(self, terms: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + _by_row(self.w[terms], row, n)
        for vector in self.v:
            x = vector[terms]
            out += 0.5 * (_by_row(x, row, n) ** 2 - _by_row(x * x, row, n))
        return out

    def scores(self, terms: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.values(terms, row, n), -40, 40)))


def fit(terms: np.ndarray, row: np.ndarray, labels: np.ndarray, rank: int = RANK, rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Logistic loss, both classes with the same total weight, full-batch Adam. Without two classes only the bias is learned."""
    y = np.asarray(labels, dtype=np.float64)
    positives, n = y.sum(), len(y)
    empty = Model(0.0, np.zeros(BUCKETS), np.zeros((rank, BUCKETS)))
    if n == 0 or positives in (0, n):
        empty.bias = 0.0 if n == 0 else (4.0 if positives else -4.0)
        return empty
    seen, toxic = np.bincount(terms, minlength=BUCKETS), np.bincount(terms, weights=y[row], minlength=BUCKETS)
    error = np.sqrt(np.maximum(seen * (n - seen), 1) / n**2 * (1 / positives + 1 / (n - positives)))
    contrast = np.abs(toxic / positives - (seen - toxic) / (n - positives)) / error
    known = np.flatnonzero((seen >= MIN_DOCUMENTS) & (contrast >= MIN_CONTRAST))
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    kept = place[terms] >= 0
    column, row = place[terms[kept]], row[kept]
    weight = np.where(y == 1, 0.5 / positives, 0.5 / (n - positives))
    random = np.random.default_rng(5)
    # one row of parameters for the weights, `rank` for the vectors
    table = np.vstack((np.zeros(len(known)), random.normal(0, 0.02, (rank, len(known)))))
    bias, steps = 0.0, [np.zeros_like(table), np.zeros_like(table), 0.0, 0.0]
    for step in range(1, rounds + 1):
        own = table[:, column]
        sums = np.stack([_by_row(x, row, n) for x in own[1:]])
        value = bias + _by_row(own[0], row, n) + 0.5 * (sums**2).sum(axis=0) - 0.5 * _by_row((own[1:] ** 2).sum(axis=0), row, n)
        slope = weight * (1 / (1 + np.exp(-np.clip(value, -40, 40))) - y)
        gradient = np.empty_like(table)
        gradient[0] = np.bincount(column, weights=slope[row], minlength=len(known))
        for r in range(rank):
            gradient[r + 1] = np.bincount(column, weights=slope[row] * (sums[r][row] - own[r + 1]), minlength=len(known))
        gradient += ridge * table
        of_bias = slope.sum()
        steps[0] = 0.9 * steps[0] + 0.1 * gradient
        steps[1] = 0.99 * steps[1] + 0.01 * gradient**2
        steps[2] = 0.9 * steps[2] + 0.1 * of_bias
        steps[3] = 0.99 * steps[3] + 0.01 * of_bias**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        # a step in proportion to the gradient where that is small keeps words that say nothing near zero
        table -= rate * (steps[0] / fix1) / (np.sqrt(steps[1] / fix2) + 1e-3)
        bias -= rate * (steps[2] / fix1) / (np.sqrt(steps[3] / fix2) + 1e-3)
    w, v = np.zeros(BUCKETS), np.zeros((rank, BUCKETS))
    w[known], v[:, known] = table[0], table[1:]
    return Model(bias, w, v)


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        terms, row = terms_of(list(frame["text"]))
        parts = np.split(terms.astype("<i4"), np.searchsorted(row, np.arange(1, len(frame))))
        yield pd.DataFrame({"toxic": frame["toxic"], "terms": [p.tobytes() for p in parts]})


def labelled_sample(documents: DataFrame, labels: DataFrame, learn_from, sample: int = SAMPLE) -> DataFrame:
    """``toxic, text`` of at most ``sample`` documents of each class, chosen by a hash of doc_id among the rows of
    ``labels`` for which ``learn_from`` holds. Documents with several labels count as toxic if one says so."""
    rows = labels.where(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("toxic = 1").orderBy(*order).limit(sample).unionByName(rows.where("toxic = 0").orderBy(*order).limit(sample))
    wanted = [r["doc_id"] for r in chosen.select("doc_id").collect()]  # 2 * sample rows at most
    return documents.select("doc_id", "text").where(F.col("doc_id").isin(wanted)).join(chosen, "doc_id").select("toxic", "text")


def train(documents: DataFrame, labels: DataFrame, learn_from, sample: int = SAMPLE) -> Model:
    """Only hashed terms of the sample come to the driver, in the order of their content, so reruns agree."""
    rows = labelled_sample(documents, labels, learn_from, sample).mapInPandas(_features, "toxic int, terms binary").collect()
    found = sorted((r["toxic"], bytes(r["terms"])) for r in rows)
    sizes = [len(t) // 4 for _, t in found]
    terms = np.frombuffer(b"".join(t for _, t in found), dtype="<i4").astype(np.int64)
    return fit(terms, np.repeat(np.arange(len(found)), sizes), np.array([y for y, _ in found]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row. Null and empty texts get the score of a document without words."""
    used = np.flatnonzero(model.w)
    packed = documents.sparkSession.sparkContext.broadcast((model.bias, used, model.w[used], model.v[:, used]))  # BUCKETS numbers each at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bias, places, w_part, v_part = packed.value
        w, v = np.zeros(BUCKETS), np.zeros((len(v_part), BUCKETS))
        w[places], v[:, places] = w_part, v_part
        own, known = Model(bias, w, v), w != 0
        for frame in frames:
            s = own.scores(*terms_of(list(frame["text"]), known), len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no whole numbers with nulls
    return rows.mapInPandas(run, "doc_id string, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast(kind))
