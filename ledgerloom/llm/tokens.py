"""Token ids of whole texts by a public tokenizer, encoding each distinct piece of text once.

Texts are cut before single spaces that stand between characters which no tokenizer takes for white space. Neither
vocabulary has a token or a rule that reaches across such a place, so the ids of the stretches are, one after the other,
the ids of the text. A stretch of plain words and signs is cut further, into runs of each. Many texts are cut at a time, by
steps over arrays of their bytes. Units recur; a worker remembers them from task to task, those asked for last. A unit of at
most 15 bytes is, with its length, a number of 128 bits, by which it is looked up exactly. New words are encoded many at a
time: one after the other they are a text in which each is a piece of its own for both tokenizers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from ledgerloom.llm.memory import Memory

REMEMBERED = 800_000  # units of at most 15 bytes, 32 bytes of a worker each with their ids, and a sixteenth as many longer ones
TOGETHER = 1 << 22  # bytes of texts that are cut and looked up at a time
JOINED = 200  # words that the library encodes as one text
LONGEST = 200  # bytes of a unit that is remembered


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, or where the public package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary_path(name, folder))
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


# Fixed values of the tokenizers' rules, cautiously. Kinds of bytes: letters, signs but the apostrophe (with which a letter can
# be one token), line ends and spaces; the letters beyond ASCII are U+00C0 to U+00FF without the signs for times and divided by.
_OTHER, _LETTER, _SIGN, _LINE, _SPACE = range(5)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER  # a byte from 0x80 on follows one that decides
_KINDS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_KINDS[ord("\n")], _KINDS[ord(" ")] = _LINE, _SPACE
_WORD = re.compile(r" [A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_SHORT = 15  # bytes of a unit that fits a key
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_SHORT + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_SHORT + 1)], np.uint64)


def _visible(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether characters with these first two bytes are surely no white space and join nothing before them: U+0021 to
    U+007E and, without times and divided by, U+00C0 to U+024F."""
    latin = (first == 0xC3) & (second != 0x97) & (second != 0xB7) | (first >= 0xC4) & (first <= 0xC8) | (first == 0xC9) & (second <= 0x8F)
    return (first > 0x20) & (first < 0x7F) | latin


def cut_units(data: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """Where the units of texts begin in their UTF-8 bytes. Each text ends with a zero byte, at ``ends``, which is a unit too;
    after the ``size`` bytes of all there are some more zeros."""
    kinds = _KINDS[data]
    special = np.flatnonzero(data == 0xC3)
    kinds[special[np.isin(data[special + 1], (0x97, 0xB7))]] = _OTHER
    spaces = np.flatnonzero(data == 0x20)
    before = data[spaces - 1]
    # a later byte of a character is looked at with the one before it; that of a longer character is no first byte
    seen = np.where(before < 0x80, _visible(before, before), (before < 0xC0) & _visible(data[spaces - 2], before) & (data[spaces - 2] >= 0xC0))
    single = seen & _visible(data[spaces + 1], data[spaces + 2])
    begins = np.zeros(size, bool)
    begins[0], begins[ends], begins[ends[:-1] + 1], begins[spaces[single]] = True, True, True, True
    starts = np.flatnonzero(begins)
    # a stretch with anything but one space in front, letters, signs and single line ends between them is one unit
    odd = kinds[:size] == _OTHER
    odd[spaces[~single]] = True
    lines = np.flatnonzero(kinds == _LINE)
    sides = [(kinds[lines + step] == _LETTER) | (kinds[lines + step] == _SIGN) for step in (-1, 1)]
    odd[lines[~(sides[0] & sides[1])]] = True
    whole = np.bitwise_or.reduceat(odd.view(np.uint8), starts).astype(bool)
    plain = np.repeat(~whole, np.diff(np.append(starts, size)))
    begins[1:] |= (kinds[1:size] != kinds[: size - 1]) & (kinds[: size - 1] != _SPACE) & plain[1:]
    return np.flatnonzero(begins)


class _Table:
    """Ids of short units: a hash table of their keys in arrays, in which many are looked up together.

    When ``limit`` keys are held, those that were asked for since the last time stay, if they are at most half of them.
    """

    def __init__(self, limit: int):
        self.limit = max(1, limit)
        self._clear(1 << 10)

    def _clear(self, slots: int) -> None:
        self.held, self.used_ids = 0, 0
        self.low, self.high = np.zeros((2, slots), np.uint64)  # a key in use has its length in the highest byte
        self.first, self.count = np.zeros((2, slots), np.int32)
        self.asked, self.owner = np.zeros(slots, bool), np.zeros(slots, np.int32)
        self.ids = np.zeros(slots, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)).astype(np.int64) & (len(self.low) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is unknown."""
        slots, found, rest = self._slots(low, high), np.full(len(low), -1, np.int64), np.arange(len(low))
        while len(rest):
            at = slots[rest]
            there = self.high[at]
            same = (there == high[rest]) & (self.low[at] == low[rest])
            found[rest[same]] = at[same]
            rest = rest[~same & (there != 0)]
            slots[rest] = (slots[rest] + 1) & (len(self.low) - 1)
        self.asked[found[found >= 0]] = True
        return found

    def add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New keys, all different, with the numbers of their ids and these one after the other; at most ``limit`` are kept."""
        if len(low) > self.limit:
            low, high, counts = low[: self.limit], high[: self.limit], counts[: self.limit]
            ids = ids[: counts.sum()]
        if self.held + len(low) > self.limit:
            kept = np.flatnonzero(self.asked & (self.high != 0))
            self._again(kept if len(kept) <= self.limit // 2 else kept[:0], len(low))
        elif 2 * (self.held + len(low)) > len(self.low):
            self._again(np.flatnonzero(self.high), len(low), True)
        if self.used_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used_ids], np.zeros(self.used_ids + 2 * len(ids), np.int32)))
        firsts = self.used_ids + np.cumsum(counts) - counts
        self.ids[self.used_ids : self.used_ids + len(ids)] = ids
        self.held, self.used_ids = self.held + len(low), self.used_ids + len(ids)
        slots, rest = self._slots(low, high), np.arange(len(low))
        while len(rest):
            at = slots[rest]
            free = self.high[at] == 0
            self.owner[at[free]] = rest[free]  # of several that come to a free slot, one gets it
            got = free.copy()
            got[free] = self.owner[at[free]] == rest[free]
            own, to = rest[got], at[got]
            self.low[to], self.high[to], self.first[to], self.count[to], self.asked[to] = low[own], high[own], firsts[own], counts[own], True
            rest = rest[~got]
            slots[rest] = (slots[rest] + 1) & (len(self.low) - 1)

    def _again(self, kept: np.ndarray, more: int, asked: bool = False) -> None:
        """A new table of the entries in the slots ``kept``, with room for ``more``."""
        low, high, counts, flags, ids = self.low[kept], self.high[kept], self.count[kept], self.asked[kept], self.ids[places(self.first[kept], self.count[kept])]
        self._clear(1 << (4 * (len(kept) + more)).bit_length())
        if len(kept):
            self.add(low, high, counts, ids)
            self.asked[self.find(low, high)] = flags if asked else False


def places(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``firsts``, one run after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts, remembered by unit."""

    def __init__(self, name: str, folder: str | None = None, remembered: int = REMEMBERED):
        self.library = tokenizer(name, folder)
        vocabulary = self.library.get_vocab()
        self.opens, self.closes = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
        # The space before a word in byte-level tokens, the end of a word in others
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.short, self.long = _Table(remembered), Memory(remembered // 16)  # the latter's ids as bytes

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of new units; words with a space in front are encoded as one text and found again by their ends."""
        words: list[str] = []
        others: list[str] = []
        for part in parts:
            (words if _WORD.fullmatch(part) else others).append(part)
        found = dict(zip(others, self._library_ids(others)))
        for begin in range(0, len(words), JOINED):
            some = words[begin : begin + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1 if self.closes.any() else np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
            if len(ends) == len(some) and ends[-1] == len(ids):
                flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                found.update(zip(some, [flat[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                found.update(zip(some, self._library_ids(some)))
        return [found[p] for p in parts]

    @staticmethod
    def _learnt(memory: Memory, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of the keys: remembered ones, and those that ``learn`` makes of the others; very long keys are not kept."""
        values, missing = memory.find(keys)
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            fresh = dict(zip(new, learn(new)))
            memory.young.update({key: ids for key, ids in fresh.items() if len(key) <= LONGEST})
            for i in missing:
                values[i] = fresh[keys[i]]
        return values

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of one text; none for null and empty texts."""
        return next(self.many([text]))

    def many(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text, looked up for many texts at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.encode() if text else b"")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._looked_up(held)
                held, size = [], 0
        if held:
            yield from self._looked_up(held)

    def _looked_up(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\0".join([*texts, bytes(16)])
        size = len(raw) - 16
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = cut_units(data, size, ends)
        lengths = np.diff(np.append(starts, size))
        stops = np.searchsorted(starts, ends)  # units that end a text
        lengths[stops] = 0
        firsts, counts = np.zeros((2, len(starts)), np.int64)
        short, long = np.flatnonzero((lengths > 0) & (lengths <= _SHORT)), np.flatnonzero(lengths > _SHORT)
        eights = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, strides=(1,))
        low = eights[starts[short]] & _LOW[lengths[short]]
        high = eights[starts[short] + 8] & _HIGH[lengths[short]] | lengths[short].astype(np.uint64) << np.uint64(56)
        slots = self.short.find(low, high)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            order = unknown[np.lexsort((low[unknown], high[unknown]))]
            new = order[np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))]
            cuts = [raw[a : a + n].decode() for a, n in zip(starts[short[new]].tolist(), lengths[short[new]].tolist())]
            ids = self._encoded(cuts)
            known, held = slots >= 0, self.short
            firsts[short[known]], counts[short[known]] = held.first[slots[known]], held.count[slots[known]]
            # new ids come after those that the table has now, which a later change of the table leaves as they are
            base, own = held.ids[: held.used_ids], np.frombuffer(b"".join(ids), np.int32)
            sizes = np.array([len(x) for x in ids]) // 4
            which = np.cumsum(np.isin(order, new)) - 1
            firsts[short[order]], counts[short[order]] = (len(base) + np.cumsum(sizes) - sizes)[which], sizes[which]
            pool = np.concatenate((base, own))
            held.add(low[new], high[new], sizes, own)
        else:
            firsts[short], counts[short], pool = self.short.first[slots], self.short.count[slots], self.short.ids[: self.short.used_ids]
        if len(long):
            values = self._learnt(self.long, [raw[a : a + n].decode() for a, n in zip(starts[long].tolist(), lengths[long].tolist())], self._encoded)
            sizes = np.array([len(x) for x in values]) // 4
            firsts[long], counts[long] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate((pool, np.frombuffer(b"".join(values), np.int32)))
        out = pool[places(firsts, counts)]
        return np.split(out, np.cumsum(counts)[stops[:-1]])


@lru_cache(maxsize=2)
def encoder(name: str, folder: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder, which keeps what it remembers between tasks."""
    return Encoder(name, folder, remembered)
