"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1, drawn from its code point. A trigram's vector is the product of its
letters' vectors, each rotated by its place; a text's vector is the sum over its trigrams, and a language's prototype
the sum over its texts. A text takes the language whose prototype has the largest cosine with it.

Letters are lower-cased; every run of other characters is one boundary symbol. Learning and prediction read every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
CHUNK = 1 << 20  # symbols that are counted together
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


@lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([20, code])).integers(0, 2, dimensions, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def folded(text: str) -> np.ndarray:
    """For each character the lower-case letter's code point, or 0."""
    return _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def symbols(text: str) -> np.ndarray:
    """The letters of a text, with one 0 before, after and for each run of other characters; empty without letters."""
    codes = folded(text)
    padded = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    keep = padded != 0
    keep[1:] |= padded[:-1] != 0
    keep[0] = True
    out = padded[keep]
    return out if len(out) > 2 else out[:0]


def trigram_vectors(parts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each row of three code points."""
    codes, place = np.unique(parts, return_inverse=True)
    place = place.reshape(parts.shape)
    letters = np.stack([letter_vector(int(c), dimensions) for c in codes])
    out = np.roll(letters, 2, axis=1)[place[:, 0]]
    out *= np.roll(letters, 1, axis=1)[place[:, 1]]
    out *= letters[place[:, 2]]
    return out


def _count_chunk(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts (rows of three code points) and how often each text has each."""
    joined = np.concatenate(texts)
    codes, place = np.unique(joined, return_inverse=True)
    base = len(codes)
    place = place.astype(np.int64)
    grams = (place[:-2] * base + place[1:-1]) * base + place[2:]
    ends = np.cumsum([len(t) for t in texts])
    if base**3 <= 1 << 22:
        known = np.flatnonzero(np.bincount(grams, minlength=1))
        column = np.zeros(base**3, dtype=np.int64)
        column[known] = np.arange(len(known))
        column = column[grams]
    else:
        known, column = np.unique(grams, return_inverse=True)
    counts = np.empty((len(texts), len(known)), dtype=np.float32)
    for row, (end, text) in enumerate(zip(ends, texts)):  # the trigrams that lie inside one text
        counts[row] = np.bincount(column[end - len(text) : end - 2], minlength=len(known))
    inside = counts.any(axis=0)
    parts = np.stack((codes[known // base**2], codes[known // base % base], codes[known % base]), axis=1)
    return parts[inside], counts[:, inside]


def _chunks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions of the texts that have symbols, grouped to about CHUNK symbols."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text):
            group.append(i)
            size += len(text)
            if size >= CHUNK or len(group) >= 256:
                yield group
                group, size = [], 0
    if group:
        yield group


def _prototypes_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        langs = frame["lang"].to_numpy()
        texts = [symbols(t) for t in frame["text"]]
        for group in _chunks(texts):
            parts, counts = _count_chunk([texts[i] for i in group])
            own = langs[group]
            found = sorted(set(own))
            by_lang = np.stack([counts[own == lang].sum(axis=0, dtype=np.float64) for lang in found])
            # whole numbers: single precision is exact below 2 ** 24
            kind = np.float32 if by_lang.sum(axis=1).max() < 1 << 24 else np.float64
            vectors = by_lang.astype(kind) @ trigram_vectors(parts).astype(kind)
            for lang, vector in zip(found, vectors):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "vector": [v.astype(np.int64) for v in sums.values()]})


def learn_prototypes(texts: DataFrame) -> DataFrame:
    """``lang, vector`` from a table with ``text`` and ``lang``: one row a language.

    Reads all rows whose text and lang are not null; each task sends one vector a language. Empty input gives no rows.
    """
    parts = texts.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInPandas(_prototypes_of_task, "lang string, vector array<bigint>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))  # DIMENSIONS values
    return sums.groupBy("lang").agg(F.transform(ordered, lambda x: x["value"]).alias("vector"))


def predict_languages(documents: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row.

    ``score`` is the cosine with the nearest prototype, negative ones as 0. A null text, one without letters, and every
    text when there are no prototypes get ``und`` and 0. Ties go to the first language in code point order. The
    prototypes, one vector a language, are collected and sent to the tasks; their size does not depend on the number of rows.
    """
    learned = sorted(((r["lang"], r["vector"]) for r in prototypes.collect()), key=lambda x: x[0])
    names = [lang for lang, _ in learned]
    matrix = np.array([v for _, v in learned], dtype=np.float64).reshape(len(names), DIMENSIONS)
    if names:
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [symbols(t) if isinstance(t, str) else np.zeros(0, np.uint32) for t in frame["text"]]
            lang, score = np.full(len(frame), UNKNOWN, dtype=object), np.zeros(len(frame))
            for group in _chunks(texts) if names else ():
                parts, counts = _count_chunk([texts[i] for i in group])
                vectors = (counts @ trigram_vectors(parts).astype(np.float32)).astype(np.float64)
                lengths = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-300)
                cosines = (vectors @ matrix.T) / lengths[:, None]
                best = cosines.argmax(axis=1)
                lang[group] = np.array(names, dtype=object)[best]
                score[group] = np.clip(cosines[np.arange(len(group)), best], 0.0, 1.0)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": lang, "score": score})

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no whole numbers with nulls
    found = rows.mapInPandas(predict, "doc_id string, lang_pred string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def held_out(parts: int, left: int):
    """Whether a document is kept from learning: crc32 of its doc_id as text, by remainder. A null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == left, F.lit(False))
