"""Packing documents into sequences of at most ``CAPACITY`` tokens by large-item matching and best fit.

Only the number of documents of each length decides how they are packed, and there are at most ``CAPACITY`` lengths, so
the plan is made on the driver from those counts, whatever the number of documents. Pieces over a third of the capacity
meet at most two to a sequence: the longest takes the longest partner that fits. The others go, longest first, to the
sequence with the smallest gap that holds them. Sequences with equal contents are one entry of the plan. Spark then
numbers the pieces of each length, in salted groups, and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.session import reliable_checkpoint

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
ROWS_PER_GROUP = 2_000  # pieces of one length that one task numbers
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """``piece, start, length, ids_crc32`` of a document's ids."""
    raw = memoryview(ids.astype("<u4").tobytes())
    starts = range(0, len(ids), capacity)
    return [(i, s, min(capacity, len(ids) - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)])) for i, s in enumerate(starts)]


def cut_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str | None = None, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """The pieces of each document's ids, the end id last; a null or empty text has the end id alone."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = tokens.encoder(vocabulary, folder, remembered)
        for frame in frames:
            rows = [(d, *p) for d, ids in zip(frame["doc_id"], of.many(frame["text"])) for p in pieces_of(np.append(ids, np.int32(END_ID)), capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, f"doc_id string, {PIECES}").withColumn("doc_id", F.col("doc_id").cast(kind))


class Plan:
    """Sequences by contents: how many pieces of which lengths, and how many sequences are filled so."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.filled = capacity, []  # (contents, number of sequences)
        self.gaps: list[int] = []  # distinct gaps of open sequences, ascending
        self.open: dict[int, list[tuple[tuple, int]]] = {}
        large = {n: c for n, c in counts.items() if 3 * n > capacity and c}
        small = {n: c for n, c in counts.items() if 3 * n <= capacity and c}
        self._match(large)
        self._fit(small)
        for gap in self.gaps:
            self.filled += self.open[gap]

    def _add(self, contents: tuple, number: int) -> None:
        gap = self.capacity - sum(n * k for n, k in contents)
        if number <= 0:
            return
        if gap == 0:
            self.filled.append((contents, number))
            return
        if gap not in self.open:
            insort(self.gaps, gap)
            self.open[gap] = []
        self.open[gap].append((contents, number))

    def _match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            longest = lengths[-1]
            at = bisect_right(lengths, self.capacity - longest) - 1
            if at < 0:
                self._add(((longest, 1),), left[longest])
                lengths.pop()
                continue
            partner = lengths[at]
            if partner == longest:
                number = left[longest] // 2
                self._add(((longest, 2),), number)
                left[longest] -= 2 * number
                if left[longest]:  # an odd one takes the next shorter partner
                    lengths.pop()
                    if lengths:
                        self._add(((longest, 1), (lengths[-1], 1)), 1)
                        left[lengths[-1]] -= 1
                        if not left[lengths[-1]]:
                            lengths.pop()
                    else:
                        self._add(((longest, 1),), 1)
                else:
                    lengths.pop()
                continue
            number = min(left[longest], left[partner])
            self._add(((longest, 1), (partner, 1)), number)
            left[longest] -= number
            left[partner] -= number
            if not left[partner]:
                lengths.pop(at)
            if not left[longest]:
                lengths.pop()

    def _fit(self, left: dict[int, int]) -> None:
        for length in sorted(left, reverse=True):
            rest = left[length]
            while rest:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    each = self.capacity // length
                    self._add(((length, each),), rest // each)
                    self._add(((length, rest % each),), 1 if rest % each else 0)
                    break
                gap = self.gaps[at]
                contents, number = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
                each = min(gap // length, rest)
                full = min(number, rest // each)
                self._add((*contents, (length, each)), full)
                self._add(contents, number - full)
                rest -= full * each

    def places(self) -> list[tuple[int, int, int, int, int, int]]:
        """``length, first, last, sequence, each, offset``: pieces of a length with numbers ``first`` to ``last`` (exclusive) go,
        ``each`` to a sequence, to the sequences from ``sequence`` on, from ``offset`` on."""
        used: dict[int, int] = {}
        out, sequence = [], 0
        for contents, number in self.filled:
            offset = 0
            for length, each in contents:
                first = used.get(length, 0)
                used[length] = first + each * number
                out.append((length, first, used[length], sequence, each, offset))
                offset += length * each
            sequence += number
        return out

    @property
    def sequences(self) -> int:
        return sum(number for _, number in self.filled)


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str | None = None, remembered: int = tokens.REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    Null and empty texts are one piece, the end id. Repeated rows are packed as often as they occur. An empty table gives an
    empty one. Documents of more than ``capacity`` tokens are cut into full pieces and a rest. The counts by length, at most
    ``capacity`` rows, come to the driver, and the plan made of them goes to the tasks: each entry of it uses up a length or a
    set of equal sequences, so its size depends on ``capacity`` only. A worker remembers ``remembered`` units of text.
    """
    spark = documents.sparkSession
    pieces = reliable_checkpoint(cut_pieces(documents, capacity, vocabulary, folder, remembered), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(sorted(Plan(counts, capacity).places()), dtype=np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(plan)
    # frequent lengths are numbered in several groups; there are at most `capacity` of them
    often = [F.lit(x) for n, c in sorted(counts.items()) if c > ROWS_PER_GROUP for x in (n, -(-c // ROWS_PER_GROUP))]
    groups = F.coalesce(F.try_element_at(F.create_map(*often), F.col("length")), F.lit(1)) if often else F.lit(1)
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups.cast("bigint")))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_group").agg(F.count("*").alias("_n")).select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_group = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_in_group", F.row_number().over(in_group) - 1).join(firsts, ["length", "_group"]).withColumn("_number", F.col("_before") + F.col("_in_group"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, firsts, _, sequences, each, offsets = sent.value.T
        for frame in frames:
            length, number = frame["length"].to_numpy(), frame["_number"].to_numpy()
            at = np.zeros(len(frame), dtype=np.int64)
            for n in np.unique(length):  # entries of a length are in order of their first numbers
                low, high = np.searchsorted(lengths, [n, n + 1])
                own = length == n
                at[own] = low + np.searchsorted(firsts[low:high], number[own], side="right") - 1
            turn = number - firsts[at]
            yield frame.drop(columns="_number").assign(sequence_id=sequences[at] + turn // each[at], offset=offsets[at] + turn % each[at] * length)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = pieces.schema["doc_id"].dataType.simpleString()
    narrow = numbered.select(F.col("doc_id").cast("string").alias("doc_id"), *columns[1:], "_number")
    placed = narrow.mapInPandas(place, f"doc_id string, {PIECES}, sequence_id bigint, offset bigint")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind))
