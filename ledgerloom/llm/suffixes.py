"""Removal of long repeated byte strings with suffix arrays.

A string of ``LENGTH`` bytes is repeated when it also starts elsewhere in the corpus. Equal strings have to meet in one
task. For that, each one is assigned to an anchor: the leftmost of its 32-byte strings with the smallest hash. Equal
strings have equal anchors, and the strings of one anchor start in a row, so a document is a list of anchors with ranges of
starts. Ranges whose anchor occurs once in the corpus hold nothing repeated. Ranges whose bytes are all equal to those of
another range are repeated as a whole. The rest is one context for each range, and the contexts of an anchor come to
one task, which sorts their suffixes: those smaller than their successors directly, the others induced from these by a
scan of the buckets of first bytes. Neighbours with a common prefix of LENGTH bytes are repeated.

Anchors with more than ``CONTEXTS`` different contexts are not gathered: their strings are counted by hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import reliable_checkpoint

LENGTH = 200
ANCHOR = 32
CONTEXTS = 20_000  # of one anchor that one task sorts
CHUNK = 1 << 22  # bytes that are hashed together
SORTED = 1 << 20  # bytes of contexts that are sorted together, but for an anchor that has more
SENT_ANCHORS = 2_000_000  # repeated anchors that are sent to the tasks; a longer list is joined by a shuffle

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLES = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling."""
    out, size = _TABLES[0][data], 1
    while size < ANCHOR:
        out = _mixed(out[: len(out) - size] * _ODD + out[size:])
        size *= 2
    return out


class RangeHashes:
    """Hashes of any ranges of some bytes, from sums over their beginnings."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        back = pow(base, -1, 1 << 64)
        powers = np.cumprod(np.full(len(data), base, dtype=np.uint64))
        self.back = np.cumprod(np.full(len(data) + 1, back, dtype=np.uint64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * powers)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _ODD)


def anchors(texts: list[bytes], with_contexts: bool) -> Iterator[tuple]:
    """``text, anchor, context, start, number`` arrays: ranges of starts of LENGTH-byte strings that have one anchor.

    Texts are taken together up to CHUNK bytes; a longer one is taken in parts, which may divide a range in two.
    """
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in part), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in part])
        ends = np.cumsum(sizes)
        grams = _gram_hashes(data)
        place = np.arange(len(grams), dtype=np.uint64)
        least = (grams >> np.uint64(24) << np.uint64(24)) | place  # the hash, then the place: the leftmost of equal ones
        width, have = LENGTH - ANCHOR + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if width > have:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.arange(len(at))
        inside = starts + LENGTH <= np.repeat(ends, sizes)[: len(at)]
        starts, at = starts[inside], at[inside]
        if not len(starts):
            return None
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
        number = np.diff(np.append(first, len(starts)))
        begin = starts[first]
        which = np.searchsorted(ends, begin, side="right")
        context = RangeHashes(data)(begin, begin + number + LENGTH - 1) if with_contexts else None
        own = np.array([t for t, _, _ in part])[which]
        shift = np.array([s for _, s, _ in part])[which] - (ends - sizes)[which]
        return own, grams[at[first]], context, begin + shift, number

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            if part and size + len(piece) > CHUNK:
                yield flush()
                part, size = [], 0
            part.append((i, at, piece))
            size += len(piece)
    if part:
        yield flush()


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _count_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for found in anchors([_utf8(t) for t in frame["text"]], False):
            if found is not None:
                values, times = np.unique(found[1], return_counts=True)
                yield pd.DataFrame({"anchor": values.view(np.int64), "times": times})


OCCURRENCES = "key bigint, key2 int, anchor bigint, context bigint, start int, number int"


def _occurrences(repeated):
    """Ranges of each text; ``repeated``, when given, holds the anchors of interest, ascending."""

    def list_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = repeated.value if repeated is not None else None
        for frame in frames:
            key, key2 = frame["key"].to_numpy(), frame["key2"].to_numpy()
            for found in anchors([_utf8(t) for t in frame["text"]], True):
                if found is None:
                    continue
                own, anchor, context, start, number = found
                anchor = anchor.view(np.int64)
                if wanted is not None:
                    keep = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor if len(wanted) else np.zeros(len(anchor), bool)
                    own, anchor, context, start, number = own[keep], anchor[keep], context[keep], start[keep], number[keep]
                yield pd.DataFrame({"key": key[own], "key2": key2[own], "anchor": anchor, "context": context.view(np.int64), "start": start, "number": number})

    return list_ranges


def sorted_suffixes(data: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The ``wanted`` places of ``data`` in the order of the bytes that follow, up to ``depth`` of them; equal ones in any order.

    Only suffixes smaller than their successor are compared. A larger one follows from its successor's rank: buckets of
    first bytes are scanned in order, and each suffix puts the one before it, if that is larger, next in its bucket.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    step = np.sign(padded[1 : n + 1].astype(np.int16) - padded[:n])  # against the next byte; equal bytes follow the next one
    decided = np.flatnonzero(step)
    following = np.searchsorted(decided, np.arange(n))
    larger = np.ones(n, dtype=bool)
    has = following < len(decided)
    larger[has] = step[decided[following[has]]] < 0
    listed = np.zeros(n + 1, dtype=bool)
    listed[wanted] = True
    ahead = wanted[larger[wanted]]
    while len(ahead):  # a larger one needs its successor
        ahead = ahead[ahead + 1 < n] + 1
        ahead = ahead[~listed[ahead]]
        listed[ahead] = True
        ahead = ahead[larger[ahead]]
    places = np.flatnonzero(listed[:n])
    direct = places[~larger[places]]
    if n and listed[n - 1] and larger[n - 1]:
        direct = np.append(direct, n - 1)  # the last one has no successor
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    low = np.searchsorted(data[direct], np.arange(257))
    put: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(entries: np.ndarray) -> np.ndarray:
        """The larger predecessors, dealt to the later buckets; returns those of the same bucket."""
        entries = entries[entries > 0] - 1
        entries = entries[listed[entries] & larger[entries]]
        firsts = data[entries]
        order = np.argsort(firsts, kind="stable")
        found, cuts = np.unique(firsts[order], return_index=True)
        same = entries[:0]
        for byte, piece in zip(found.tolist(), np.split(entries[order], cuts[1:])):
            if byte == bucket:
                same = piece
            else:
                put[byte].append(piece)
        return same

    for bucket in range(256):
        mine = direct[low[bucket] : low[bucket + 1]]
        last = mine[larger[mine]] if len(mine) else mine
        waiting = np.concatenate((last, *put[bucket])) if put[bucket] or len(last) else None
        while waiting is not None and len(waiting):
            out.append(waiting)
            waiting = before(waiting)
        mine = mine[~larger[mine]] if len(mine) else mine
        if len(mine):
            out.append(mine)
            before(mine)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    asked = np.zeros(n + 1, dtype=bool)
    asked[wanted] = True
    return order[asked[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one after it, ``most`` at most (a multiple of 8)."""
    padded = np.concatenate((data, np.zeros(most + 8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(), shape=(len(padded) - 7, 8), strides=(1, 1))
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int64)
    alive = np.arange(len(out))
    for at in range(0, most, 8):
        a = np.ascontiguousarray(words[order[alive] + at]).view("<u8").ravel()
        b = np.ascontiguousarray(words[order[alive + 1] + at]).view("<u8").ravel()
        differ = a ^ b
        low = differ & (~differ + np.uint64(1))
        out[alive] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        alive = alive[differ == 0]
        if not len(alive):
            break
    return out


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context which of its LENGTH-byte strings occur again, in it or in another one."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    numbers = np.array([len(c) - LENGTH + 1 for c in contexts])
    begin = np.cumsum([0, *[len(c) for c in contexts[:-1]]])
    wanted = np.repeat(begin - (np.cumsum(numbers) - numbers), numbers) + np.arange(numbers.sum())
    order = sorted_suffixes(data, wanted)
    equal = common_prefixes(data, order) >= LENGTH
    again = np.zeros(len(data), dtype=bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [again[b : b + n] for b, n in zip(begin.tolist(), numbers.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), flags.astype(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RANGES = "key bigint, key2 int, first int, last int"


def _sort_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated ranges of contexts that occur once; the rows come sorted by anchor."""
    held: list[pd.DataFrame] = []
    size = 0

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        marks = repeated_starts(rows["bytes"].tolist())
        found = [[], [], [], []]
        for key, key2, start, times, flags in zip(rows["key"], rows["key2"], rows["start"], rows["times"], marks):
            if times == 1 and flags.any():
                first, last = _runs(flags)
                found[0] += [key] * len(first)
                found[1] += [key2] * len(first)
                found[2] += (first + start).tolist()
                found[3] += (last + start).tolist()
        return pd.DataFrame(dict(zip(("key", "key2", "first", "last"), found)))

    for frame in frames:
        held.append(frame)
        size += int(frame["bytes"].map(len).sum())
        if size < SORTED:
            continue
        rows = pd.concat(held, ignore_index=True)
        whole = rows["anchor"] != rows["anchor"].iloc[-1]  # more rows of the last anchor may follow
        if whole.any():
            yield work(rows[whole])
        held = [rows[~whole]]
        size = int(held[0]["bytes"].map(len).sum())
    if held:
        yield work(pd.concat(held, ignore_index=True))


def _cut_contexts(hot: bool):
    """Context bytes of each request of a text; for hot anchors two hashes of each of its strings."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, key, key2, asked in zip(frame["text"], frame["key"], frame["key2"], frame["asked"]):
                data = _utf8(text)
                for r in asked:
                    context = data[r["start"] : r["start"] + r["number"] + LENGTH - 1]
                    if not hot:
                        out.append((key, key2, r["anchor"], r["start"], r["times"], context))
                        continue
                    part = np.frombuffer(context, dtype=np.uint8)
                    begin = np.arange(r["number"])
                    one, two = (RangeHashes(part, w)(begin, begin + LENGTH).view(np.int64).tolist() for w in (0, 1))
                    out += [(key, key2, a, b, r["start"] + i, r["times"]) for i, (a, b) in enumerate(zip(one, two))]
            names = ["key", "key2", "one", "two", "first", "times"] if hot else ["key", "key2", "anchor", "start", "times", "bytes"]
            yield pd.DataFrame(out, columns=names)

    return cut


def repeated_ranges(keyed: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """``key, key2, first, last`` of all ranges of starts of repeated LENGTH-byte strings, from ``key, key2, text``."""
    spark = keyed.sparkSession
    counts = keyed.select("text").mapInPandas(_count_anchors, "anchor bigint, times bigint").groupBy("anchor").agg(F.sum("times").alias("times"))
    repeated = reliable_checkpoint(counts.where("times > 1").select("anchor"), "anchors")
    rows = keyed.select("key", "key2", "text")
    if repeated.count() <= SENT_ANCHORS:
        wanted = np.sort(repeated.toArrow()["anchor"].to_numpy())
        found = rows.mapInPandas(_occurrences(spark.sparkContext.broadcast(wanted)), OCCURRENCES)
    else:
        found = rows.mapInPandas(_occurrences(None), OCCURRENCES).join(repeated, "anchor")
    found = reliable_checkpoint(found, "ranges")

    first = F.min(F.struct("key", "key2", "start", "number")).alias("_at")
    by_context = found.groupBy("anchor", "context").agg(F.count("*").alias("times"), first)
    of_anchor = by_context.groupBy("anchor").agg(F.count("*").alias("_contexts"))
    known = reliable_checkpoint(by_context.join(of_anchor, "anchor").where("times > 1 OR _contexts > 1"), "contexts")
    several = known.where("times > 1").select("anchor", "context")
    whole = found.join(several, ["anchor", "context"]).select("key", "key2", F.col("start").alias("first"), (F.col("start") + F.col("number") - 1).alias("last"))

    def asked(which) -> DataFrame:
        requests = known.where(which).select("_at.*", "anchor", "times")
        by_text = requests.groupBy("key", "key2").agg(F.collect_list(F.struct("anchor", "start", "number", "times")).alias("asked"))  # of one text
        return rows.join(by_text, ["key", "key2"])

    cut = asked((F.col("_contexts") > 1) & (F.col("_contexts") <= contexts)).mapInPandas(
        _cut_contexts(False), "key bigint, key2 int, anchor bigint, start int, times bigint, bytes binary"
    )
    by_suffix = cut.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_sort_contexts, RANGES)
    out = whole.unionByName(by_suffix)
    hot = F.col("_contexts") > contexts
    if known.where(hot).limit(1).count():
        strings = reliable_checkpoint(asked(hot).mapInPandas(_cut_contexts(True), "key bigint, key2 int, one bigint, two bigint, first int, times bigint"), "strings")
        again = strings.groupBy("one", "two").agg(F.sum("times").alias("_n")).where("_n > 1").drop("_n")
        single = strings.where("times = 1").join(again, ["one", "two"]).select("key", "key2", "first", F.col("first").alias("last"))
        out = out.unionByName(single)
    return out


def _removed(flat: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes: first places and ends."""
    edge = np.zeros(size + 1, dtype=np.int32)
    for first, last in flat:
        edge[first] += 1
        edge[last + LENGTH] -= 1
    first, last = _runs(np.cumsum(edge)[:size] > 0)
    return first, last + 1


def _removals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for text, ranges in zip(frame["_text"], frame["ranges"]):
            data = _utf8(text)
            if ranges is None or not len(ranges):
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), text))
                continue
            first, end = _removed([(r["first"], r["last"]) for r in ranges], len(data))
            kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)]))
            out.append((len(data), int((end - first).sum()), len(first), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        frame = frame.drop(columns=["_text", "ranges"])
        frame[["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]] = pd.DataFrame(out, index=frame.index, columns=["a", "b", "c", "d", "e"])
        yield frame


def remove_repeats(documents: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of each row of ``documents`` (doc_id, text).

    A byte goes when a LENGTH-byte string that covers it also starts elsewhere in the input, in the same document or
    another one; every copy goes, and what is left is not judged again. A null text is empty; its ``kept_text`` is null.
    Texts below LENGTH bytes stay. Repeated rows are repeated texts. Characters of which some bytes went are left out of
    ``kept_text``, and only there.
    """
    texts = documents.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"))
    # together with the text's checksum, 96 bits that only equal rows share
    key, key2 = F.xxhash64("_id", "_text"), (F.crc32(F.coalesce("_text", F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    keyed = texts.select("_id", "_text", key.alias("key"), key2.alias("key2"))
    found = repeated_ranges(keyed.select("key", "key2", F.col("_text").alias("text")), contexts)
    by_text = found.distinct().groupBy("key", "key2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # of one text
    joined = keyed.join(by_text, ["key", "key2"], "left").select("_id", "_text", "ranges")
    kept = joined.mapInPandas(_removals, "_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return kept.select(F.col("_id").cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
