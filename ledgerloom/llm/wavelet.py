"""Token ids in shard files: a wavelet matrix per shard.

A shard is one row of a Parquet file: its bytes hold the ids of a run of whole documents as bit planes with counts of
ones at regular places, and the documents' ids and lengths. One shard can be opened alone for access to any token,
counts of an id before a place, places of its occurrences, and all ids. Parquet carries the bytes because Spark
writes it atomically to any store; the planes need 16 bits a token for a vocabulary of up to 65,536 ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.session import work_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 19  # a shard is closed when it has so many; documents are not divided
STEP = 512  # places between two counts of ones
MAGIC = b"WMX1"


class WaveletMatrix:
    """Bit planes of a sequence of whole numbers below ``2 ** bits``, the highest bit first."""

    def __init__(self, size: int, planes: list[np.ndarray]):
        self.size, self.planes = size, planes  # packed bits, padded to whole steps
        per_step = [np.bitwise_count(p.reshape(-1, STEP // 8)).sum(axis=1, dtype=np.int64) if len(p) else np.zeros(0, np.int64) for p in planes]
        self.ones = [np.concatenate(([0], np.cumsum(x))) for x in per_step]
        self.zeros = [size - int(x[-1]) for x in self.ones]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        values = np.asarray(values).astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits):
            bit = (values & values.dtype.type(1 << (bits - 1 - level))) != 0
            packed = np.packbits(bit)
            planes.append(np.concatenate((packed, np.zeros(-len(packed) % (STEP // 8), np.uint8))))
            values = np.concatenate((values[~bit], values[bit]))
        return cls(len(values), planes)

    def _bits(self, level: int, places: np.ndarray) -> np.ndarray:
        return (self.planes[level][places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1

    def _rank1(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        places = np.asarray(places, dtype=np.int64)
        block = places // STEP
        plane = np.append(self.planes[level], np.zeros(STEP // 8, np.uint8))
        steps = plane[(block * (STEP // 8))[..., None] + np.arange(STEP // 8)]
        inside = (places % STEP)[..., None] - 8 * np.arange(STEP // 8)
        mask = (0xFF00 >> np.clip(inside, 0, 8)).astype(np.uint8)
        return self.ones[level][block] + np.bitwise_count(steps & mask).sum(axis=-1, dtype=np.int64)

    def access(self, places) -> np.ndarray:
        """The values at the places."""
        places = np.asarray(places, dtype=np.int64)
        out = np.zeros(places.shape, dtype=np.int64)
        for level in range(len(self.planes)):
            bit, ones = self._bits(level, places), self._rank1(level, places)
            out = out * 2 + bit
            places = np.where(bit == 1, self.zeros[level] + ones, places - ones)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(len(self.planes)):
            a, b = self._rank1(level, np.array([low, high])).tolist()
            if value >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, end: int) -> int:
        """How often the value stands before place ``end``."""
        if value < 0 or value >> len(self.planes):
            return 0
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _select(self, level: int, bit: int, numbers: np.ndarray) -> np.ndarray:
        """Places of a plane's ones (or zeros) with these numbers, from 0: their steps by binary search on the counts, then inside the step."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * STEP - self.ones[level]
        step = np.searchsorted(before, numbers, side="right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, STEP // 8)[step], axis=1)
        reached = np.cumsum(bits if bit else 1 - bits, axis=1, dtype=np.int16) > (numbers - before[step])[:, None]
        return step * STEP + reached.argmax(axis=1)

    def _places(self, value: int, places: np.ndarray) -> np.ndarray:
        """Where occurrences that end up at ``places`` of the last order stand in the sequence."""
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            places = self._select(level, bit, places - self.zeros[level] if bit else places)
        return places

    def occurrences(self, value: int) -> np.ndarray:
        """All places of a value, ascending."""
        if value < 0 or value >> len(self.planes):
            return np.zeros(0, dtype=np.int64)
        low, high = self._range(value, self.size)
        parts = [self._places(value, np.arange(at, min(at + STEP, high))) for at in range(low, high, STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence, from 0. Reads one step of each plane; IndexError beyond the last occurrence."""
        low, high = self._range(value, self.size) if 0 <= value and not value >> len(self.planes) else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError(k)
        return int(self._places(value, np.array([low + k]))[0])

    def decode(self) -> np.ndarray:
        """All values in order: the planes are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.size, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.size).view(bool)
            before = np.empty_like(values)
            before[~bit] = values[: self.zeros[level]]
            before[bit] = values[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            values = before
        return values


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard: head, documents, planes."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    matrix = WaveletMatrix.build(ids, bits)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<IQI", bits, len(ids), len(doc_ids))
    return b"".join((head, known.tobytes(), numbers.tobytes(), np.array(lengths, dtype="<i8").tobytes(), *[p.tobytes() for p in matrix.planes]))


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents' ids, their lengths and the matrix of a shard."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    bits, size, n = struct.unpack("<IQI", data[4:20])
    at = 20
    known = np.frombuffer(data, np.uint8, n, at)
    numbers = np.frombuffer(data, "<i8", n, at + n)
    lengths = np.frombuffer(data, "<i8", n, at + 9 * n)
    at, step = at + 17 * n, -(-size // STEP) * (STEP // 8)
    planes = [np.frombuffer(data, np.uint8, step, at + i * step) for i in range(bits)]
    return [int(d) if k else None for d, k in zip(numbers, known)], lengths, WaveletMatrix(size, planes)


def write_shards(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> None:
    """Write the ids of ``documents`` (doc_id, text) as shards in ascending doc_id order, null ids first.

    Null and empty texts have the end id alone. Repeated doc_ids follow one another by text. A range of doc_ids is one task; a
    range is as large as the shuffle's partitions are.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, part, seq = tokens.encoder(vocabulary, folder), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def shard():
            data = shard_bytes(doc_ids, [len(x) for x in ids], np.concatenate(ids))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [held], "shard": [data]})

        for frame in frames:
            for doc_id, own in zip(frame["doc_id"], of.many(frame["text"])):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(np.append(own, np.int32(END_ID)))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield shard()
                    doc_ids, ids, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    rows = documents.select(F.col("doc_id").cast("decimal(19,0)").alias("doc_id"), "text")  # pandas has no whole numbers with nulls
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInPandas(encode, "part int, seq int, n_tokens bigint, shard binary")
    shards.write.option("compression", "zstd").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the shards below ``path``."""
    shards = spark.read.schema("part int, seq int, n_tokens bigint, shard binary").parquet(path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, seq, data in zip(frame["part"], frame["seq"], frame["shard"]):
                doc_ids, lengths, matrix = open_shard(data)
                ends = np.cumsum(lengths)
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(doc_ids, dtype="Int64"), "inside": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    documents = shards.select("part", "seq", "shard").mapInPandas(decode, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = shards.select("part", "seq", "n_tokens")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).alias("base"))
    return documents.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(documents: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Write the shards, by default to the shared work folder, and return what reading them back gives."""
    path = path or work_path(documents.sparkSession, "shards")
    write_shards(documents, path, vocabulary, folder)
    return read_shards(documents.sparkSession, path)
